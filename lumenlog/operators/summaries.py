"""Summaries by day that can be merged: counts, distinct-count sketches and quantile sketches.

A day is summarised once, from its own rows, and stored in a partition of its own; summarising it again replaces it. Questions about
any span of days merge the stored rows, a few bytes for each key and day, and read no log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.sources.io import overwrite_partitions

#: log2 of the registers of a distinct-count sketch (standard error about 0.8 %) and items per level of a quantile sketch (rank error
#: about 1 %; up to so many values it is exact).
REGISTERS = 14
LEVEL_ITEMS = 400


def summarise(df: DataFrame, day: str, keys: list[str], counts: dict[str, Column], distinct: dict[str, Column], quantiles: dict[str, Column]) -> DataFrame:
    """One row for each day and key: ``rows``, the sums in ``counts``, a sketch of the distinct values of each column in ``distinct``
    and of the distribution of each in ``quantiles``. Nulls enter neither kind of sketch; rows without a day are left out."""
    return df.filter(F.col(day).isNotNull()).groupBy(day, *keys).agg(
        F.count("*").alias("rows"),
        *[F.sum(c).alias(n) for n, c in counts.items()],
        *[F.hll_sketch_agg(c.cast("string"), REGISTERS).alias(f"{n}_distinct") for n, c in distinct.items()],
        *[F.kll_sketch_agg_double(c.cast("double"), LEVEL_ITEMS).alias(f"{n}_values") for n, c in quantiles.items()],
        *[F.count(c).alias(f"{n}_n") for n, c in quantiles.items()],
        *[F.sum(c.cast("double")).alias(f"{n}_sum") for n, c in quantiles.items()],
    )


def store(summary: DataFrame, path: str, day: str) -> None:
    """Write the days of a summary, each in place of what was stored for it."""
    overwrite_partitions(summary, path, day)


def merged(spark: SparkSession, path: str, keys: list[str], first: str | None = None, last: str | None = None, day: str = "log_date") -> DataFrame:
    """The stored days (of a span, ends included) as one row per key, sketches still as sketches."""
    rows = spark.read.parquet(path)
    for bound, inside in ((first, F.col(day) >= F.lit(first).cast("date")), (last, F.col(day) <= F.lit(last).cast("date"))):
        rows = rows if bound is None else rows.filter(inside)
    how = {c: F.hll_union_agg(c) if c.endswith("_distinct") else F.kll_merge_agg_double(c, LEVEL_ITEMS) if c.endswith("_values") else F.sum(c) for c in rows.columns if c not in keys and c != day}
    return rows.groupBy(*keys).agg(*[a.alias(c) for c, a in how.items()])


def estimate(name: str) -> Column:
    """Distinct values of a summary's sketch."""
    return F.hll_sketch_estimate(f"{name}_distinct")


def quantile(name: str, q: float) -> Column:
    """A quantile of a summary's sketch, null where it holds no value."""
    return F.when(F.col(f"{name}_n") > 0, F.kll_sketch_get_quantile_double(f"{name}_values", F.lit(q)))


def mean(name: str) -> Column:
    return F.try_divide(f"{name}_sum", f"{name}_n")


def cluster_effectiveness(spark: SparkSession, path: str, name: str, keys: list[str]) -> DataFrame:
    """Cardinality of the cluster keys and rows for each combination, from the stored days alone."""
    one = merged(spark, path, [])
    cards = [estimate(k).alias(f"cluster_key_{i}_cardinality") for i, k in enumerate(keys, 1)]
    per_combo = F.try_divide(F.col("rows"), F.nullif(estimate("combination"), F.lit(0)))
    return one.select(F.lit(f"{name} ({','.join(keys)})").alias("table_cluster_config"), F.col("rows").alias("total_rows"), *cards, per_combo.alias("avg_rows_per_cluster_combo"))


def combination(keys: list[str]) -> Column:
    """The keys of a row as one value, null if one of them is."""
    return F.concat(*[F.col(k).cast("string") for k in keys])
