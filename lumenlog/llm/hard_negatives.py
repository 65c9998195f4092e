"""Hard negatives: rows of other labels whose score lies in a window below each positive's score.

The windows of an anchor's positives overlap, but their upper limits cut the scores into disjoint slots: slot j holds what lies at or
below the j-th highest limit and above the next one. A window's best rows are the best of its own slot and of all slots below, so it
is enough to keep the k best of every slot. Tasks keep k per slot of the rows they see, these are merged per slot, and going up from
the lowest slot each window takes its slot's rows into the best so far; what is under its lower limit is left out at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.topk import matrix, quantised
from lumenlog.session import materialize

#: Rows in a shard and anchors in a block: a task holds one of each, and one tile of scores.
SHARD_ROWS = 1 << 15
BLOCK_ANCHORS = 1 << 15
TILE_SCORES = 1 << 22


def _exact(bound: float) -> type:
    """The fastest type in which whole numbers up to ``bound`` are added up exactly."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


class Sides:
    """The rows of a shard in order of their ids, the anchors of a block, and their scores tile by tile."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        dims = max([1, *(int(x) for t in (rows, anchors) for x in pc.list_value_length(t["v"]).unique().to_pylist())])
        order = np.lexsort((rows["row"].to_numpy(), rows["id"].to_numpy()))
        self.id, self.row = rows["id"].to_numpy()[order], rows["row"].to_numpy()[order]
        self.anchor = anchors["row"].to_numpy()
        v, a = matrix(rows["v"], dims)[order], matrix(anchors["v"], dims)
        kind = _exact(float(np.abs(v).max(initial=0)) * float(np.abs(a).max(initial=0)) * dims)
        self.v, self.a = v.astype(kind), a.astype(kind)
        labels, codes = np.unique(np.concatenate([rows["label"].to_numpy(zero_copy_only=False), anchors["label"].to_numpy(zero_copy_only=False)]).astype(str), return_inverse=True)
        self.label, self.anchor_label = codes[: len(order)][order], codes[len(order) :]

    def tiles(self):
        """(first anchor, scores of some anchors with all rows) as whole numbers."""
        step = max(1, TILE_SCORES // max(1, len(self.id)))
        for lo in range(0, len(self.anchor), step):
            yield lo, (self.a[lo : lo + step] @ self.v.T).astype(np.int64)


def _best(group: np.ndarray, score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their group: higher scores first, then smaller positions (ids)."""
    order = np.lexsort((at, -score, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < k]


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        if rows.num_rows and anchors.num_rows:
            side = Sides(rows, anchors)
            lowest = np.iinfo(np.int64).min
            for lo, score in side.tiles():
                n = len(score)
                fits = (side.anchor_label[lo : lo + n, None] == side.label) & (side.anchor[lo : lo + n, None] != side.row)
                score = np.where(fits, score, lowest)
                # What is below the k-th score of an anchor cannot be among its best; ties are settled by _best.
                edge = np.partition(score, -k, axis=1)[:, -k][:, None] if score.shape[1] > k else lowest
                who, at = np.nonzero(fits & (score >= edge))
                keep = _best(who, score[who, at], at, k)
                who, at = who[keep], at[keep]
                for column, values in zip(out, (side.anchor[lo + who], side.id[at], score[who, at])):
                    column.append(values)
        return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(("anchor", "other", "score"), out)})

    return run


def _slots(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if rows.num_rows and anchors.num_rows:
            side = Sides(rows, anchors)
            limits, floor = matrix(anchors["upper"], int(pc.max(pc.list_value_length(anchors["upper"])).as_py())), anchors["lowest"].to_numpy()
            counts = pc.list_value_length(anchors["upper"]).to_numpy()
            limits[np.arange(limits.shape[1]) >= counts[:, None]] = np.iinfo(np.int64).min
            for lo, score in side.tiles():
                n = len(score)
                fits = (side.anchor_label[lo : lo + n, None] != side.label) & (score <= limits[lo : lo + n, :1]) & (score >= floor[lo : lo + n, None])
                who, at = np.nonzero(fits)
                found = score[who, at]
                # The number of limits at or above a score is its slot.
                slot = (found[:, None] <= limits[lo + who]).sum(1)
                keep = _best(who * (limits.shape[1] + 1) + slot, found, at, k)
                for column, values in zip(out, (side.anchor[lo + who[keep]], slot[keep], side.id[at[keep]], found[keep])):
                    column.append(values)
        return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(("anchor", "slot", "other", "score"), out)})

    return run


def _meet(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, work, schema: str) -> DataFrame:
    """Every shard of rows with every block of anchors, each pair in a task of its own."""

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    held = rows.select("row", "id", "label", "v", dealt(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = anchors.withColumns({"block": dealt(blocks), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    return held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(work, schema)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", scale: int = 256, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each positive of an anchor the best rows of
    other labels whose score is ``lower`` to ``upper`` percent of the positive's.

    Scores are inner products of ``floor(scale * x)``. An anchor's positives are its best other rows of the same label; higher scores
    come first, ties go to the smaller id. Rows take no part whose id, label or vector is null or whose vector holds a null or
    non-finite component; missing components of shorter vectors count as 0. Repeated rows are rows of their own: a copy of an anchor
    may be its positive, and each anchor row has its own result. Anchors without positives, and positives without a row in their
    window (always so below a score of 0), have no rows; an empty table gives none. Scores times 100 must fit 64-bit integers. Only
    the named columns are read.

    Rows are dealt into shards and anchors into blocks by row number, so neither a label nor repeated ids gather in one task; a task
    gives back at most k rows per anchor and slot.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), label.cast("string").alias("label"), quantised(vector_col, scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mining-vectors")
    anchors = rows.filter("anchor").select("row", "id", "label", "v")
    size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    shards, blocks = max(1, -(-size["n"] // SHARD_ROWS)), max(1, -(-size["a"] // BLOCK_ANCHORS))

    near = _meet(rows, anchors, shards, blocks, _positives(positives), "anchor bigint, other bigint, score bigint")
    best = materialize(_ranked(near, ["anchor"], positives), "mining-positives")
    # Below a score of 0 the window is empty; from there on whole-number division rounds as it must.
    windows = best.filter("score >= 0").select("anchor", F.col("rank").alias("place"), F.col("other").alias("positive"), "score", F.expr(f"(score * {lower} + 99) div 100").alias("low"), F.expr(f"(score * {upper}) div 100").alias("high"))
    held = F.array_sort(F.collect_list(F.struct("place", "positive", "score", "low", "high")))
    windows = windows.groupBy("anchor").agg(held.alias("windows"), F.min("low").alias("lowest"))
    asked = anchors.join(windows.select(F.col("anchor").alias("row"), F.col("windows.high").alias("upper"), "lowest"), "row")
    asked = materialize(asked, "mining-anchors")

    found = _meet(rows, asked, shards, blocks, _slots(negatives), "anchor bigint, slot bigint, other bigint, score bigint")
    slots = _ranked(found, ["anchor", "slot"], negatives)
    slots = slots.groupBy("anchor").agg(F.collect_list(F.struct((-F.col("score")).alias("down"), "other", F.col("slot").cast("int").alias("slot"))).alias("slots"))
    answers = slots.join(windows.select("anchor", "windows"), "anchor").select("anchor", F.explode(_suffixes(negatives)).alias("w"))
    out = answers.select("anchor", "w.window.*", F.posexplode("w.best").alias("at", "n"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return out.join(ids, "anchor").select(
        "anchor_id", F.col("positive").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("n.other").alias("negative_id"), F.col("score").alias("positive_score"), (-F.col("n.down")).alias("negative_score"),
    )


def _suffixes(k: int) -> Column:
    """For each window the k best of its slot and all lower ones: from the last window up, the best so far take in one slot more.

    ``slots`` has at most k rows of each slot, ``windows`` one entry for each slot; neither grows with the table.
    """

    def step(state: Column, window: Column) -> Column:
        own = F.filter("slots", lambda s: s["slot"] == window["place"])
        best = F.slice(F.array_sort(F.concat(state["best"], own)), 1, k)
        inside = F.filter(best, lambda s: -s["down"] >= window["low"])
        return F.struct(best.alias("best"), F.concat(state["out"], F.array(F.struct(window.alias("window"), inside.alias("best")))).alias("out"))

    entry = "struct<down:bigint,other:bigint,slot:int>"
    window = "struct<place:int,positive:bigint,score:bigint,low:bigint,high:bigint>"
    start = F.struct(F.expr(f"CAST(array() AS array<{entry}>)").alias("best"), F.expr(f"CAST(array() AS array<struct<window:{window},best:array<{entry}>>>)").alias("out"))
    return F.aggregate(F.reverse("windows"), start, step, lambda s: s["out"])
