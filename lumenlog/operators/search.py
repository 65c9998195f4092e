"""Exact, filtered, grouped and hybrid vector search; ``vector_index`` has the searches for many queries at once.

Search is filter, score, top-k: filters run before scoring, scoring is batched, and each task hands on at most k candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.columns import literal_like
from lumenlog.functions.vectors import cosine, cosine_with, dot, euclidean, literal_vector, top_matches, usable

ID, VECTOR = "vec_id", "embedding"


def ranked(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), ID)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def filters(
    df: DataFrame, equals: dict[str, object] | None = None, start: str | None = None, end: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Equality filters on payload fields and a time range; unknown fields are refused."""
    for column, value in (equals or {}).items():
        if column not in df.columns:
            raise ValueError(f"no payload field {column}")
        df = df.filter(F.col(column) == F.lit(value))
    if start:
        df = df.filter(F.col(ts) >= literal_like(df, ts, start))
    if end:
        df = df.filter(F.col(ts) <= literal_like(df, ts, end))
    return df


def with_score(df: DataFrame, query: list[float]) -> DataFrame:
    """Usable rows with their cosine to one query."""
    return df.filter(usable(VECTOR, len(query))).withColumn("score", cosine_with(VECTOR, query))


def semantic_search(
    df: DataFrame, query: list[float], top_k: int = 10, threshold: float | None = 0.5, offset: int = 0, payload: list[str] | None = None
) -> DataFrame:
    """Best rows by cosine, above a threshold; the payload is fetched for the winners only."""
    hits = top_matches(df, ID, VECTOR, {0: query}, top_k + offset).drop("query_id")
    if threshold is not None:
        hits = hits.filter(F.col("score") >= threshold)
    best = hits.orderBy(F.desc("score"), ID).offset(offset).limit(top_k)
    if not payload:
        return best
    return df.select(ID, *payload).join(F.broadcast(best), ID)  # at most top_k rows


def batch_search(df: DataFrame, queries: dict[int, list[float]], k: int) -> DataFrame:
    """Top-k of several queries in one pass over the corpus."""
    return ranked(top_matches(df, ID, VECTOR, queries, k), k)


def search_groups(df: DataFrame, query: list[float], group_by: str, group_size: int = 1, limit: int = 10) -> DataFrame:
    """Best hits per payload group, best groups first; tasks keep ``group_size`` rows per group before shuffling."""
    scored = with_score(df.filter(F.col(group_by).isNotNull()), query).select(ID, group_by, "score")
    inside = Window.partitionBy(group_by).orderBy(F.desc("score"), ID)
    hits = scored.withColumn("rank", F.row_number().over(inside)).filter(F.col("rank") <= group_size)
    # A group's hits, at most ``group_size``, travel as one row, so the corpus is scored once.
    groups = hits.groupBy(group_by).agg(F.sort_array(F.collect_list(F.struct("rank", ID, "score"))).alias("hits"), F.max("score").alias("group_score"))
    best = groups.orderBy(F.desc("group_score"), F.col("hits")[0][ID]).limit(limit)
    return best.select(group_by, "group_score", F.inline("hits"))


def rrf(legs: list[DataFrame], limit: int, k: int = 2) -> DataFrame:
    """Reciprocal-rank fusion of ranked legs (id, rank): the sum of 1 / (k + rank)."""
    parts = [leg.select(ID, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part")) for leg in legs]
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return union.groupBy(ID).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), ID).limit(limit)


def dbsf(legs: list[DataFrame], limit: int) -> DataFrame:
    """Distribution-based fusion: each leg's scores scaled by its mean ± three deviations, then added."""
    out = None
    for leg in legs:
        stats = leg.agg(F.lit(1).alias("_one"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("_mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("_dev"))
        leg = leg.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")  # one row
        low, width = F.col("_mean") - 3 * F.col("_dev"), 6 * F.col("_dev")
        share = F.when(width > 0, (F.col("score") - low) / width).otherwise(0.5)
        scaled = leg.select(ID, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).alias("part"))
        out = scaled if out is None else out.unionByName(scaled)
    return out.groupBy(ID).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), ID).limit(limit)


def hybrid_search(df: DataFrame, query: list[float], sparse: DataFrame, limit: int, prefetch: int | None = None, fusion: str = "rrf") -> DataFrame:
    """Dense and sparse legs, each fetched ten deeper than asked, fused."""
    depth = prefetch or limit + 10
    dense = batch_search(df, {0: query}, depth)
    legs = [dense, sparse.filter(F.col("rank") <= depth)]
    return rrf(legs, limit) if fusion == "rrf" else dbsf(legs, limit)


def formula_rescore(df: DataFrame, query: list[float], formula: str, limit: int = 10) -> DataFrame:
    """Order by a caller's SQL expression over the score and the payload."""
    return with_score(df, query).withColumn("final_score", F.expr(formula)).orderBy(F.desc("final_score"), ID).limit(limit)


def scroll(df: DataFrame, limit: int, after: int | None = None) -> DataFrame:
    """Rows in id order without scoring, from after a given id on."""
    rows = df if after is None else df.filter(F.col(ID) > after)
    return rows.orderBy(ID).limit(limit)


def collection_stats(df: DataFrame, payload: list[str]) -> DataFrame:
    return df.agg(
        F.count("*").alias("points"), F.max(F.size(VECTOR)).alias("dim"), *[F.count_distinct(c).alias(f"{c}_values") for c in payload]
    )


def distances(df: DataFrame, query: list[float]) -> DataFrame:
    q = literal_vector(query)
    return df.select(ID, cosine(VECTOR, q).alias("cosine"), dot(VECTOR, q).alias("dot"), euclidean(VECTOR, q).alias("euclid"))
