"""Exact copies by radix partitioning: texts are split by successive bytes until a group is a single text or has ended.

The first digit is the length in bytes together with the first bytes, so most texts are alone at once and leave without being
looked at again. What is left is split by longer and longer runs of the following bytes. Groups are told apart by the bytes
themselves; no digest decides that two texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.marks import marked, marks, numbered, unmarked, without_ids
from lumenlog.session import materialize

FIRST_BYTES = 64
GROWTH = 16
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _members(df: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Every row with its group (level and node, no node if it is alone), the group's size and smallest id, and its place in its level
    (none if it is alone); ``row`` if it is named."""
    text = normalised(F.col(text_col))
    own = ["id"] if row_col is None else ["id", "row"]
    named = [F.col(c).alias(name) for c, name in zip((id_col, row_col), own)]
    rows = df.select(*named, text.alias("t"))
    rows = rows.select(*own, F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").cast("long").alias("parent"), F.col("t").cast("binary").alias("rest"))
    done, seen, step, level = [], 0, FIRST_BYTES, 0
    while True:
        seen += step
        head, tail = F.substring("rest", 1, step), F.expr(f"substring(rest, {step + 1})")
        nodes = rows.groupBy("parent", head.alias("head")).agg(F.count("*").alias("n"), F.min("id").alias("rep")).filter("n > 1")
        nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), f"radix-nodes-{level}")
        # Rows whose length and first bytes no other text has leave here without being moved.
        found = marks(nodes, "parent", "head")
        near = marked(rows, found, F.col("parent"), head).select(*own, "sha", "parent", head.alias("head"), tail.alias("rest"))
        split = near.join(nodes.hint("merge"), ["parent", "head"], "left")
        open_text = F.col("node").isNotNull() & (F.octet_length("rest") > 0)
        split = split.select(*own, "sha", "node", "n", "rep", F.when(open_text, F.col("rest")).alias("rest"))
        # With its level, the place of a row in what is written here tells it from rows that repeat its id and text.
        stored = materialize(split.withColumn("place", F.monotonically_increasing_id()), f"radix-{level}")
        alone = unmarked(rows, found, F.col("parent"), head).select(*own, "sha")
        done.append(alone.select(*own, "sha", F.lit(level).alias("level"), *[F.lit(None).cast("bigint").alias(c) for c in ("node", "n", "place")], F.col("id").alias("rep")))
        done.append(stored.filter("rest IS NULL").select(*own, "sha", F.lit(level).alias("level"), "node", "n", "place", "rep"))
        rows = stored.filter("rest IS NOT NULL").select(*own, "sha", F.col("node").alias("parent"), "rest")
        if rows.isEmpty():
            break
        step, level = step * GROWTH, level + 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id`` (smallest id of its group), ``group_size``, ``kept``, ``text_sha256``.

    Only the two named columns are read, so other columns may have any name. A null text equals an empty one. Null ids are passed
    over when the smallest id is sought; a group of null ids alone has a null ``keep_id``. Of rows that repeat the kept id exactly
    one has ``kept``. An empty table gives an empty result.

    Counts of (group, bytes) are combined before the shuffle, and rows meet them in a plain join that Spark may split, so a group
    of copies of any size spreads over tasks. Every level is written to the shared folder; a level holds only texts that still
    share all bytes seen so far with another one.
    """
    alone = F.col("node").isNull()
    found = _members(df, id_col, text_col)
    found = found.select("id", "sha", "level", "node", "place", F.coalesce("n", F.lit(1)).alias("n"), F.when(alone, F.col("id")).otherwise(F.col("rep")).alias("rep"))
    may_stay = ~alone & F.col("id").eqNullSafe(F.col("rep"))
    # One of the rows with the kept id, however many there are: combined before the shuffle, then met by a key of its own.
    first = found.filter(may_stay).groupBy("level", "node").agg(F.min("place").alias("place")).select("level", "place", F.lit(True).alias("first"))
    stays = found.filter(may_stay).join(first, ["level", "place"], "left").withColumn("kept", F.coalesce("first", F.lit(False)))
    stays = stays.select(*found.columns, "kept")
    rest = found.filter(~may_stay).withColumn("kept", alone)
    return stays.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("rep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts one row with the smallest id, null ids last.

    Ids may repeat or be null: rows are told apart by a number of their own, and of several rows with the smallest id the one that
    was written first stays. A null text equals an empty one; whole texts are compared, however long. Other columns are carried
    along, whatever their names. An empty table gives an empty result.
    """
    rows, row = numbered(df, "exact-rows")
    shared = _members(rows, id_col, text_col, row).filter("node IS NOT NULL")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row"))["row"]
    stays = shared.groupBy("level", "node").agg(first.alias("row"))
    gone = shared.select("row").join(stays, "row", "left_anti")
    return without_ids(rows, row, gone).drop(row)
