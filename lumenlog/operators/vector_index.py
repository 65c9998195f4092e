"""Nearest neighbours for many queries at once: exactly, and through a stored index of cells.

The index is an inverted file: every vector lies in the cell of its nearest centre, and a search looks into the cells nearest to each
query. Centres are fitted on a bounded sample; every vector is indexed. Rows are stored by zone, a range of cells, so a search reads
the zones it needs; new vectors are assigned to the stored centres and added as batches, each of which can be written again.

Rows and queries meet cell by cell in one plan. A cell is cut into parts of bounded size by a hash of the id, and its queries into
blocks, so a crowded cell means more tasks and never a larger one. Each task returns at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.functions.vectors import usable
from lumenlog.session import materialize

#: Rows and queries that meet in one task.
PART_ROWS = 1 << 15
BLOCK_QUERIES = 1 << 13
#: Bound of the sample that the centres are fitted on, and of their number.
SAMPLE_ROWS = 1 << 16
MOST_CELLS = 1 << 14
ZONE_CELLS = 16
HITS = "query_id bigint, vec_id bigint, score double"


def _meeting(k: int, id_column: str):
    """Best k rows of a group for each of its queries. Self-contained, as it runs on executors."""

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            matrices = []
            for t in (rows, queries):
                flat = t["vector"].combine_chunks()
                flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
                m = np.asarray(flat.flatten(), dtype=np.float64).reshape(t.num_rows, -1)
                matrices.append(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))
            ids, asked = rows["id"].to_numpy(), queries["query_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, held = ids[order], matrices[0][order]
            step = max(1, (1 << 21) // len(ids))
            for lo in range(0, len(asked), step):
                scores = matrices[1][lo : lo + step] @ held.T
                edge = np.partition(scores, -k, axis=1)[:, -k][:, None] if len(ids) > k else -np.inf
                who, at = np.nonzero(scores >= edge)
                # By query, falling score, rising id; equal scores at the edge are cut by id.
                place = np.lexsort((at, -scores[who, at], who))
                who, at = who[place], at[place]
                first = np.searchsorted(who, np.arange(len(scores)))
                keep = np.arange(len(who)) - first[who] < k
                out[0].append(asked[lo + who[keep]])
                out[1].append(ids[at[keep]])
                out[2].append(scores[who[keep], at[keep]])
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(flat[0].astype("int64")), id_column: pa.array(flat[1].astype("int64")), "score": pa.array(flat[2].astype("float64"))})

    return meet


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _dealt(column: str, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def indexable(vector: str, dim: int) -> Column:
    """Right dimension, not all zeros, and every component a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return usable(vector, dim) & ~F.coalesce(odd, F.lit(True))


def as_queries(df: DataFrame, condition: Column, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows that meet ``condition``, as (query_id, vector)."""
    return df.filter(condition).select(F.col(id_column).cast("bigint").alias("query_id"), F.col(vector).alias("vector"))


def exact_search(df: DataFrame, queries: DataFrame, k: int, dim: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank: the k best rows by cosine for every query; ties go to the smaller id.

    Parts of the table meet blocks of queries, both of bounded size. Rows and queries of another dimension, and all zeros, take no part.
    Vectors are stored before they are checked, counted and met, so those made from texts are made once.
    """
    rows = materialize(df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("vector")), "search-rows").filter(indexable("vector", dim))
    queries = materialize(queries, "search-queries").filter(indexable("vector", dim))
    parts, blocks = (max(1, -(-t.count() // most)) for t, most in ((rows, PART_ROWS), (queries, BLOCK_QUERIES)))
    rows = rows.select("id", "vector", _dealt("id", parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select("query_id", "vector", _dealt("query_id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    hits = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(_meeting(k, "vec_id"), HITS)
    return _best(hits, k)


# --- the stored index -------------------------------------------------------------------------------------------------


def fit_centres(df: DataFrame, cells: int, dim: int, vector: str = "embedding", id_column: str = "vec_id", rounds: int = 12) -> np.ndarray:
    """Unit centres by spherical k-means on at most ``SAMPLE_ROWS`` rows, picked by a hash of the id (all rows if there are fewer)."""
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"1 to {MOST_CELLS} cells")
    rows = df.filter(indexable(vector, dim)).select(F.xxhash64(id_column).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    picked = [r["v"] for r in rows.orderBy("h", "v").limit(SAMPLE_ROWS).collect()]
    if not picked:
        return np.eye(1, dim)
    x = np.asarray(picked)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[lo : lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def _nearest(shared, probes: int):
    """For each vector the numbers of its nearest centres, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if batch.num_rows:
                flat = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                near = np.argsort(-(flat @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                cells = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * near.shape[1], pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], names=["id", "vector", "cells"])

    return run


def _with_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows
    return rows.mapInArrow(_nearest(shared, probes), "id bigint, vector array<float>, cells array<int>")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS rows
    return np.asarray([r["vector"] for r in rows])


def add_vectors(df: DataFrame, path: str, batch: str, id_column: str = "vec_id", vector: str = "embedding") -> None:
    """Index the usable rows of ``df`` as one batch; the same batch again replaces itself. Ids must be new to the other batches."""
    spark = df.sparkSession
    centres = _centres(spark, path)
    rows = df.filter(indexable(vector, centres.shape[1])).select(F.col(id_column).cast("bigint"), F.col(vector).cast("array<float>"))
    placed = _with_cells(rows, centres, 1).select("id", "vector", F.col("cells")[0].alias("cell"))
    placed = placed.withColumn("zone", F.floor(F.col("cell") / ZONE_CELLS).cast("int"))
    placed.hint("rebalance", "zone").sortWithinPartitions("zone", "cell").write.mode("overwrite").partitionBy("zone").parquet(f"{path}/rows/batch={batch}")


def build_index(df: DataFrame, path: str, cells: int, dim: int, id_column: str = "vec_id", vector: str = "embedding", batch: str = "first") -> None:
    """Fit the centres, store them, and index all of ``df``."""
    centres = fit_centres(df, cells, dim, vector, id_column)
    df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    add_vectors(df, path, batch, id_column, vector)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, vec_id, score, rank: for every query the k best rows of its ``probes`` nearest cells, by exact cosine.

    All queries go through one plan. With as many probes as there are cells the result is exact.
    """
    centres = _centres(spark, path)
    queries = queries.filter(indexable("vector", centres.shape[1])).select(F.col("query_id"), F.col("vector").cast("array<float>"))
    asked = materialize(_with_cells(queries, centres, probes).select(F.col("id").alias("query_id"), "vector", F.explode("cells").alias("cell")), "index-probes")
    stored = spark.read.schema("id bigint, vector array<float>, cell int, batch string, zone int").parquet(f"{path}/rows")
    # One row for each cell, of which there are at most MOST_CELLS.
    sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    loads = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    plan = materialize(sizes.join(loads, "cell").withColumn("zone", F.floor(F.col("cell") / ZONE_CELLS).cast("int")), "index-cells")
    zones = [r["zone"] for r in plan.select("zone").distinct().collect()]
    wanted = F.broadcast(plan.select("cell", "parts", "blocks"))
    rows = stored.filter(F.col("zone").isin(zones)).join(wanted, "cell")
    rows = rows.select("cell", "id", "vector", _dealt("id", F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = asked.join(wanted, "cell").select("cell", "query_id", "vector", _dealt("query_id", F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keys = ["cell", "part", "block"]
    hits = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_meeting(k, "vec_id"), HITS)
    return _best(hits, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each query's exact hits that an approximate search found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1.0).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
