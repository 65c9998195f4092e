"""Exact top-k search by inner product with MaxScore over shards of impact-ordered postings.

Vectors have integer components. Every component of a query is a term; its postings in a shard are the vectors whose component has
the same sign, with what they add to the score, the largest first. A term's bound is its largest addition. Terms whose bounds
together cannot lift a vector over the k-th best score so far are non-essential: only the other postings are traversed, and the
non-essential ones are probed for vectors that are still competitive. What components of the other sign take away can only lower a
score, so it is looked up last, for the few vectors left. The best of all shards are merged.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.session import materialize

SHARD_VECTORS = 8192
QUERY_BLOCK = 512


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector is null or holds a null or non-finite component."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~F.coalesce(odd, F.lit(True)), whole)


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows; those with fewer components than ``dims`` are filled up with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(starts)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], size)] = flat
    return out


class Shard:
    """The postings of a block of vectors: for every dimension and sign, vectors by falling size of their component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for d in range(vectors.shape[1]):
            column = self.vectors[:, d]
            for sign in (1, -1):
                at = np.flatnonzero(column * sign > 0)
                at = at[np.argsort(-column[at] * sign, kind="stable")]
                if len(at):
                    self.postings[d, sign] = at, column[at] * sign

    def _scored(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.vectors[at] @ query

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the k best for a query other than its own vector; ties go to the smaller id."""
        terms = []
        for d in np.flatnonzero(query).tolist():
            posting = self.postings.get((d, 1 if query[d] > 0 else -1))
            if posting is not None:
                weight = abs(int(query[d]))
                terms.append((weight * int(posting[1][0]), weight, d, posting))
        terms.sort(key=lambda t: t[0])
        bounds = np.cumsum([t[0] for t in terms])
        # A first threshold from the heads of the strongest postings.
        heads = np.unique(np.concatenate([t[3][0][: 4 * k] for t in terms[-4:]])) if terms else np.zeros(0, np.int64)
        heads = heads[self.ids[heads] != own]
        threshold = np.partition(self._scored(query, heads), -k)[-k] if len(heads) >= k else None
        essential = int(np.searchsorted(bounds, threshold, "left")) if threshold is not None else 0
        reached = np.zeros(len(self.ids), np.int64)
        for _, weight, _, (at, size) in terms[essential:]:
            reached[at] += weight * size
        live = np.arange(len(self.ids))
        if threshold is not None:
            left = int(bounds[essential - 1]) if essential else 0
            live = live[reached + left >= threshold]
            # Probe the non-essential terms, strongest first, while a vector can still get over the threshold.
            for i in range(essential - 1, -1, -1):
                left -= terms[i][0]
                _, weight, d, _ = terms[i]
                sign = 1 if query[d] > 0 else -1
                reached[live] += weight * np.maximum(self.vectors[live, d] * sign, 0)
                live = live[reached[live] + left >= threshold]
        live = live[self.ids[live] != own]
        score = self._scored(query, live)
        best = np.lexsort((self.ids[live], -score))[:k]
        return live[best], score[best]


def _search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if candidates.num_rows and queries.num_rows:
            dims = max(int(x) for t in (candidates, queries) for x in pc.list_value_length(t["v"]).unique().to_pylist())
            shard = Shard(candidates["id"].to_numpy(), matrix(candidates["v"], dims))
            for own, query in zip(queries["id"].to_numpy(), matrix(queries["v"], dims)):
                at, score = shard.top(query, own, k)
                out[0].extend([own] * len(at))
                out[1].extend(shard.ids[at].tolist())
                out[2].extend(score.tolist())
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out)})

    return run


def max_score(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other vectors for every query, all of them if there are fewer.

    ``is_query`` picks the queries among the rows of ``df``. Vectors that are null or hold a null or non-finite component take no
    part, nor do rows with a null id. Missing components of shorter vectors count as 0; an empty vector scores 0 with all. Rows
    that repeat a query's id are not its candidates; of repeated queries the smallest vector asks; other repeated rows are
    candidates each for itself. Scores must fit 64-bit integers. Only the two named columns are read; an empty table gives an
    empty result.

    Vectors are dealt into shards and queries into blocks, both of bounded size; every block meets every shard in a task of its
    own, and gives back at most k rows per query.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), quantised(vector_col, scale).alias("v"), is_query.alias("q"))
    rows = materialize(rows.filter("id IS NOT NULL AND v IS NOT NULL"), "search-vectors")
    queries = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    shards, blocks = max(1, -(-size["n"] // SHARD_VECTORS)), max(1, -(-size["q"] // QUERY_BLOCK))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    held = rows.select("id", "v", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select("id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
