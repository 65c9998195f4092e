"""Mixing sources to target weights along a low-discrepancy schedule.

Each source's documents are shuffled into one stream of words and cut into blocks of equal length. Multiples of the golden ratio
modulo 1 are mapped through the cumulative shares of the sources: point j says which source fills slot j. The r-th slot of a
source takes its r-th block, starting over when the stream is used up. Every source is so spread evenly over the whole mix and
gives exactly the words its target asks for, rounded to whole words.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.ordered import running_sum
from lumenlog.llm import words as W
from lumenlog.llm.marks import numbered
from lumenlog.session import local_table, materialize

BLOCK_WORDS = 1024
MOST_REPEATS = 3
#: Sources a mix may have; their totals (one row each) are all that the driver sees.
MOST_SOURCES = 100_000
STREAM_ROWS = 4096
CHUNK_SLOTS = 1 << 16
GOLDEN = np.uint64(11400714819323198485)
_SLICE_BYTES = 1 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = W.buffers(batch.column(2))
        size = np.zeros(batch.num_rows, np.int64)
        for lo, hi in W.slices(starts, _SLICE_BYTES):
            size[lo:hi] = np.bincount(W.words(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]).row, minlength=hi - lo)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(size), batch.column(3)], names=["id", "source", "size", "uid"])


def targets(sizes: list[int], weights: list[int], total: int | None = None, most: int = MOST_REPEATS) -> list[Fraction]:
    """Shares of ``total`` by weight; no share exceeds ``most`` times its size, and what is over goes to the others by weight."""
    left = Fraction(sum(sizes) if total is None else total)
    out: dict[int, Fraction] = {i: Fraction(0) for i, s in enumerate(sizes) if s == 0}
    while len(out) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in out]
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > most * sizes[i]]
        if not full:
            out |= {i: per * weights[i] for i in open_}
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
    return [out[i] for i in range(len(sizes))]


def _points(edges: np.ndarray, slots: int):
    """The source of every slot and its rank among that source's slots of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                j = np.arange(chunk * CHUNK_SLOTS, min(slots, (chunk + 1) * CHUNK_SLOTS), dtype=np.uint64)
                point = ((j + np.uint64(1)) * GOLDEN >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                source = np.minimum(np.searchsorted(edges, point, "right"), len(edges) - 1)
                order = np.argsort(source, kind="stable")
                ranked = source[order]
                head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                rank = np.empty(len(j), np.int64)
                rank[order] = np.arange(len(j)) - np.repeat(head, np.diff(np.concatenate([head, [len(j)]])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), chunk, np.int64)), pa.array(j.astype(np.int64)), pa.array(source.astype(np.int32)), pa.array(rank)], names=["chunk", "slot", "sid", "rank"]
                )

    return run


def _schedule(spark, need: list[int]) -> DataFrame:
    """(slot, sid, rank): which source fills each slot; source i fills exactly ``need[i]`` slots, ranked from 0."""
    slots, kinds = sum(need), "slot bigint, sid int, rank bigint"
    if not slots:
        return local_table(spark, [], kinds)
    edges = np.cumsum(np.asarray(need, np.float64)) / slots
    chunks = spark.range(0, -(-slots // CHUNK_SLOTS))
    drawn = materialize(chunks.mapInArrow(_points(edges, slots), "chunk bigint, slot bigint, sid int, rank bigint"), "mix-points")
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = running_sum(counts, ["sid"], "chunk", "n", "upto", levels=1).select("sid", "chunk", (F.col("upto") - F.col("n")).alias("before"))
    ranked = drawn.join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("rank") + F.col("before")).alias("rank"))
    # The points miss each share by a few slots at most: what is over is left out, what is missing follows at the end.
    got = {r["sid"]: r["n"] for r in counts.groupBy("sid").agg(F.sum("n").alias("n")).collect()}
    wanted, missing, at = [], [], slots
    for sid, n in enumerate(need):
        have = got.get(sid, 0)
        wanted.append((sid, n))
        if have < n:
            missing.append((sid, have, n - 1, at))
            at += n - have
    known = local_table(spark, wanted, "sid int, need bigint")
    ranked = ranked.join(known, "sid").filter("rank < need").select("slot", "sid", "rank")
    late = local_table(spark, missing, "sid int, low bigint, high bigint, at bigint").withColumn("rank", F.explode(F.sequence("low", "high")))
    return ranked.unionByName(late.select((F.col("at") + F.col("rank") - F.col("low")).alias("slot"), "sid", "rank"))


class Mix:
    """A mix of a table: ``rows`` (uid, id, source, size, source_size, target) and ``pieces``, its slots in words.

    ``pieces`` has slot, sid, epoch, uid, start, length: slot by slot, the words [start, start + length) of a document. Sources
    are taken in code point order, null last, and weigh 1, 2, 3, repeating, unless ``weights`` (source to weight) is given; they
    share the words of all documents. A null text has no words and is never taken; a null source is a source like others; rows
    that repeat an id are taken each for itself. Only the named columns are read; ``row_col``, a number of its own for every row, is
    the uid if it is given. An empty table makes an empty mix.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, block_words: int = BLOCK_WORDS, row_col: str | None = None):
        spark = df.sparkSession
        uid = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
        plain = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("t"), uid.alias("uid"))
        sized = materialize(plain.mapInArrow(_count, "id bigint, source string, size bigint, uid bigint"), "mix-sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
        if len(totals) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in totals]
        shares = [i % 3 + 1 if weights is None else weights[r["source"]] for i, r in enumerate(totals)]
        target = targets(sizes, shares)
        take = [int(t + Fraction(1, 2)) for t in target]
        table = [(i, r["source"], r["size"], float(t), -(-r["size"] // block_words), n // r["size"] if r["size"] else 0, n % r["size"] if r["size"] else 0) for i, (r, t, n) in enumerate(zip(totals, target, take))]
        known = local_table(spark, table, "sid int, source string, source_size bigint, target double, blocks bigint, epochs bigint, rest bigint")
        named = known.withColumnRenamed("source", "_source")
        self.rows = sized.join(F.broadcast(named), sized["source"].eqNullSafe(named["_source"])).select("uid", "id", "source", "sid", "size", "source_size", "target")

        # Each source's stream: documents by a hash, cut into runs so that no task holds a whole source.
        runs = max(1, sum(r["rows"] for r in totals) // STREAM_ROWS)
        shuffled = self.rows.filter("size > 0").select("uid", "id", "sid", "size", F.xxhash64("id", "size").alias("h"))
        shuffled = shuffled.withColumn("run", F.pmod(F.shiftrightunsigned("h", 20), F.lit(runs)))
        inside = Window.partitionBy("sid", "run").orderBy("h", "id", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
        lengths = shuffled.groupBy("sid", "run").agg(F.sum("size").alias("words"))
        starts = running_sum(lengths, ["sid"], "run", "words", "upto", levels=1).select("sid", "run", (F.col("upto") - F.col("words")).alias("begin"))
        stream = shuffled.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(starts, ["sid", "run"])
        stream = stream.select("uid", "sid", "size", (F.col("begin") + F.col("inside")).alias("at"))
        block = F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))).alias("block")
        cut = stream.select("uid", "sid", "at", "size", block)
        low, high = F.greatest("at", F.col("block") * block_words), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
        cut = cut.select("uid", "sid", "block", low.alias("low"), high.alias("high"), "at")

        need = [epochs * blocks + -(-rest // block_words) for _, _, _, _, blocks, epochs, rest in table]
        slots = _schedule(spark, need).join(F.broadcast(known.select("sid", "blocks", "epochs", "rest")), "sid")
        slots = slots.withColumns({"epoch": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")})
        filled = slots.join(cut, ["sid", "block"])
        end = F.when(F.col("epoch") == F.col("epochs"), F.least("high", "rest")).otherwise(F.col("high"))
        self.pieces = filled.withColumn("end", end).filter("end > low").select("slot", "sid", "epoch", "uid", (F.col("low") - F.col("at")).alias("start"), (F.col("end") - F.col("low")).alias("length"))


def mixed_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, and how many of its words the mix takes, repeats counted."""
    mix = Mix(df, id_col, text_col, source_col)
    taken = mix.pieces.groupBy("uid").agg(F.sum("length").alias("taken"))
    return mix.rows.join(taken, "uid", "left").select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: a row for every time a document is taken, with all its columns. Rows that repeat an id count apart.

    A document of which a last pass takes only a part is taken whole if that is half of its words or more, and not at all if less.
    """
    rows, row = numbered(df, "mix-rows")
    mix = Mix(rows, id_col, text_col, source_col, row_col=row)
    passes = mix.pieces.groupBy("uid", "epoch").agg(F.sum("length").alias("words")).join(mix.rows.select("uid", "size"), "uid")
    times = passes.filter("2 * words >= size").groupBy("uid").agg(F.count("*").cast("int").alias("_times")).withColumnRenamed("uid", "_uid")
    copy = "_copy"
    while copy in df.columns:
        copy += "_"
    copies = F.explode(F.sequence(F.lit(1), times["_times"])).alias(copy)
    return rows.join(times, rows[row] == times["_uid"]).select(*[rows[c] for c in df.columns], copies).drop(copy)
