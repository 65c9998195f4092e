"""What filters do to each other: every order of a set of filters, from tables of the ids that fail them.

Each filter leaves one table with the numbers of the rows it fails. Any beginning of an order is a set of filters, so the lattice of
these sets is all there is to know: rows left by every filter of a set are a left-anti join with the failing rows of its filters;
what the next filter takes from them is a left-semi join of its own failing rows with those left, what it would have taken is the
left-anti join. The set is part of the join's key, so one join serves the whole lattice. Orders only look up their sets.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.exact_dedup import WHITE
from lumenlog.session import materialize, scratch_path

MOST_FILTERS = 6


def word_list(text: Column) -> Column:
    """The maximal runs of characters other than white space."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text that is not null: few words, repetitive, shouting, odd symbols."""
    words = word_list(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        "C": F.lit(100) * capitals > F.lit(3) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _copies(rows: DataFrame) -> DataFrame:
    """Rows whose text also belongs to a smaller id. Only digests move; of a group of copies one row per task."""
    text = ["size", "sha"]
    first = rows.groupBy(*text).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    return rows.filter("id IS NOT NULL").join(first.hint("merge"), text).filter("id > first").select("row")


def failing(df: DataFrame, filters: dict[str, Column], id_col: str, text_col: str, part_col: str, copies: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows, fails): every row as number, id and part; and one table of row numbers for each filter, a folder of its own on disk.

    ``filters`` are conditions on the column ``t``, the text with null as empty. ``copies`` names the filter that fails a text which
    a smaller id has too.
    """
    spark = df.sparkSession
    text = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    marks = F.array(*[F.when(c, F.lit(f)) for f, c in filters.items()])
    rows = text.select("id", "part", F.octet_length("t").alias("size"), F.unhex(F.sha2("t", 256)).alias("sha"), F.array_compact(marks).alias("fails"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "audit-rows")
    found = rows.select("row", F.explode("fails").alias("filter"))
    if copies is not None:
        found = found.unionByName(_copies(rows).select("row", F.lit(copies).alias("filter")))
    path = scratch_path(spark, "audit-fails")
    found.write.partitionBy("filter").parquet(path)
    return rows.select("row", "id", "part"), spark.read.schema("row bigint, filter string").parquet(path)


def flagged(rows: DataFrame, labels: DataFrame, id_col: str, flags: dict[str, Column]) -> DataFrame:
    """``rows`` with a flag for each condition that some label row of the id meets. Null ids have no labels."""
    held = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f) for f, c in flags.items()])
    joined = rows.join(held.hint("merge"), "id", "left")
    return joined.select("row", "part", *[F.coalesce(f, F.lit(False)).cast("int").alias(f) for f in flags])


def audit(df: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", flags: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For every part, order of the filters and step: counts of rows ``kept``, ``removed``, ``redundant``, ``unique_fails``, the
    rows lost for each flag, and ``shapley``, the filter's removed rows added up over all orders.

    A null text is empty, a null part the empty string. Repeated rows are rows of their own; of equal texts those with the smallest
    id pass the copy filter, and so do rows with a null id. A document counts for a flag if one of its label rows does, and once;
    labels without a document count nowhere. An empty table gives an empty result. Only the named columns are read. At most
    ``MOST_FILTERS`` filters, since orders are their factorial.

    Row numbers, parts and flags are all that is shuffled; a row is in the lattice 2^filters times, whatever its part or text. The
    key (set, row) is unique, so no task gets more than its share. Counts are combined before they move. The joins merge: a size that is
    estimated from the files knows neither that they are packed nor that a row has many sets, and would send the lattice through the driver.
    """
    filters = text_filters(F.col("t")) if filters is None else filters
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1} if flags is None else flags
    names = [*filters, *([copies] if copies is not None else [])]
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of their own")
    every, bit = (1 << len(names)) - 1, {f: 1 << i for i, f in enumerate(names)}
    rows, fails = failing(df, filters, id_col, text_col, part_col, copies)
    documents = flagged(rows, labels, id_col, flags)
    number = F.create_map(*[F.lit(x) for f in names for x in (f, bit[f])])
    fails = fails.select("row", number[F.col("filter")].cast("int").alias("bit"))

    sets = F.sequence(F.lit(0), F.lit(every))
    inside = F.col("set").bitwiseAND(F.col("bit")) != 0
    struck = fails.withColumn("set", F.explode(sets)).filter(inside)
    left = documents.withColumn("set", F.explode(sets)).join(struck.select("set", "row").hint("merge"), ["set", "row"], "left_anti")
    # The other way round: a filter's failing rows against what a set without it leaves.
    asked = fails.join(documents.hint("merge"), "row").withColumn("set", F.explode(sets)).filter(~inside)
    there = left.select("set", "row").hint("merge")
    taken = asked.join(there, ["set", "row"], "left_semi")
    missed = asked.join(there, ["set", "row"], "left_anti")

    measures = ["kept", "removed", "redundant", *[f"{f}_lost" for f in flags]]

    def counted(frame: DataFrame, by: Column, **values: Column) -> DataFrame:
        return frame.groupBy("part", "set", by.alias("bit")).agg(*[F.sum(values.get(m, F.lit(0))).cast("long").alias(m) for m in measures])

    found = counted(left, F.lit(0), kept=F.lit(1))
    found = found.unionByName(counted(taken, F.col("bit"), removed=F.lit(1), **{f"{f}_lost": F.col(f) for f in flags}))
    found = found.unionByName(counted(missed, F.col("bit"), redundant=F.lit(1)))
    found = found.groupBy("part", "set", "bit").agg(*[F.sum(m).alias(m) for m in measures])
    return _by_order(found, names, measures)


def _by_order(found: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    """The counts of sets (for each part a map no longer than the lattice) read off along every order."""
    filters = len(names)
    every = (1 << filters) - 1

    def key(s: Column | int, b: Column | int) -> Column:
        return (F.lit(s) * (every + 1) + F.lit(b)).cast("int")

    def value(k: Column, m: str) -> Column:
        return F.coalesce(F.col("counts")[k][m], F.lit(0).cast("long"))

    def shapley(b: int) -> Column:
        without = [s for s in range(every + 1) if not s & (1 << b)]
        orders = [math.factorial(s.bit_count()) * math.factorial(filters - 1 - s.bit_count()) for s in without]
        return functools.reduce(operator.add, [F.lit(n) * value(key(s, 1 << b), "removed") for s, n in zip(without, orders)])

    entry = F.struct(key(F.col("set"), F.col("bit")).alias("k"), F.struct(*measures).alias("v"))
    # The empty set leaves every row, so each part is here; counts that are not are zero.
    by_part = found.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("counts"))
    by_part = by_part.withColumn("shares", F.array(*[shapley(b) for b in range(filters)]))
    orders = [("".join(names[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in itertools.permutations(range(filters)) for k in range(filters)]
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(s).alias("before"), F.lit(b).alias("at"), F.lit(1 << b).alias("bit")) for o, k, s, b in orders])
    steps = by_part.withColumn("s", F.explode(steps)).select("part", "counts", "shares", "s.*")
    here = [value(key(F.col("before"), F.col("bit")), m).alias(m) for m in measures if m != "kept"]
    return steps.select(
        "part", "filter_order", "step",
        value(key(F.col("before").bitwiseOR(F.col("bit")), 0), "kept").alias("kept"),
        *here,
        value(key(F.lit(every).bitwiseXOR(F.col("bit")), F.col("bit")), "removed").alias("unique_fails"),
        F.col("shares")[F.col("at")].alias("shapley"),
    )
