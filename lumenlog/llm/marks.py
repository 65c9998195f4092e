"""Narrowing a large table to the rows that may have one of many keys, without moving the others.

Keys are hashed into a fixed number of marks, and the marks that occur are broadcast: at most ``MARKS`` rows however many keys there
are. Rows without a mark certainly have none of the keys; the others go on to an exact join. Where nearly every mark occurs, nearly
every row goes on, which costs what the plain join would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.session import materialize

MARKS = 1 << 18


def _mark(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(MARKS)).cast("int")


def marks(df: DataFrame, *key: str) -> DataFrame:
    """The marks of the keys in ``df``."""
    return df.select(_mark(*[F.col(k) for k in key]).alias("_mark")).distinct()


def marked(df: DataFrame, found: DataFrame, *key: Column) -> DataFrame:
    """Rows that may have one of the keys."""
    return df.join(F.broadcast(found), _mark(*key) == found["_mark"], "left_semi")


def unmarked(df: DataFrame, found: DataFrame, *key: Column) -> DataFrame:
    """Rows that have none of the keys."""
    return df.join(F.broadcast(found), _mark(*key) == found["_mark"], "left_anti")


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written with a number of its own for every row, and the name of that column; ids may repeat or be null."""
    row = "_row"
    while row in df.columns:
        row += "_"
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), label), row


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is not the first column of ``gone``; a null id is gone if a null is there."""
    gone = gone.select(gone[gone.columns[0]].alias("_gone_id")).distinct()
    found = marks(gone, "_gone_id")
    ids = df[id_col].cast(gone.schema[0].dataType)
    exact = marked(df, found, ids).join(gone.hint("merge"), ids.eqNullSafe(gone["_gone_id"]), "left_anti")
    return unmarked(df, found, ids).unionByName(exact)
