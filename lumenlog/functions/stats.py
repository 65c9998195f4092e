"""Quantiles that hold at scale.

``quantile`` is the mergeable sketch: its buffer is bounded by ``ACCURACY`` however large or skewed a group is, tasks combine
partial sketches, and groups below about ACCURACY/2 rows come out exact (the rank error of larger ones is 1/ACCURACY). ``exact_quantiles`` is for reports that promise the
exact order statistic: the sketch brackets each quantile, one counting pass ranks the bracket, and only the few rows inside
the bracket are ever sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.columns import col

ACCURACY = 10_000
BRACKET = 100_000


def quantile(value: str | Column, fraction: float) -> Column:
    """Approximate quantile that is an element of the data (smallest value whose rank reaches the fraction)."""
    return F.percentile_approx(col(value), fraction, ACCURACY)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], slack: int = BRACKET) -> DataFrame:
    """Interpolated quantiles per key, exact at any size (what PERCENTILE_CONT gives).

    One key may hold most of the rows: the first pass keeps a bounded sketch per key, the second counts the rows below each
    bracket and pre-aggregates the values inside it, so no task ever holds a whole group.
    """
    rows = df.filter(F.col(value).isNotNull())
    names = list(fractions)
    steps = [min(max(f + d, 0.0), 1.0) for f in fractions.values() for d in (-4.0 / slack, 4.0 / slack)]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx(value, steps, slack).alias("_edges"), F.count("*").alias("_n"))
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_c")).join(sketch, keys)
    v, edges = F.col(value), F.col("_edges")
    bounds = []
    for i in range(len(names)):  # one value more on either side, since interpolation may need the neighbour
        low, high = edges[2 * i], edges[2 * i + 1]
        bounds.append(F.coalesce(F.max(F.when(v < low, v)), F.min(low)).alias(f"_low{i}"))
        bounds.append(F.coalesce(F.min(F.when(v > high, v)), F.max(high)).alias(f"_high{i}"))
    counted = counted.drop("_edges").join(counted.groupBy(*keys).agg(*bounds), keys)
    inside = [v.between(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in range(len(names))]
    below = counted.groupBy(*keys).agg(*[F.sum(F.when(v < F.col(f"_low{i}"), F.col("_c")).otherwise(0)).alias(f"_below{i}") for i in range(len(names))])
    window = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    kept = counted.filter(reduce(Column.__or__, inside))
    kept = kept.withColumns({f"_to{i}": F.sum(F.when(hit, F.col("_c")).otherwise(0)).over(window) for i, hit in enumerate(inside)})
    ranked = kept.join(below, keys)
    picks = []
    for i, name in enumerate(names):
        position = F.lit(fractions[name]) * (F.col("_n") - 1)
        end = F.col(f"_below{i}") + F.col(f"_to{i}")
        start = end - F.col("_c")

        def at(rank: Column, start: Column = start, end: Column = end, hit: Column = inside[i]) -> Column:
            return F.max(F.when(hit & (start <= rank) & (rank < end), v))

        a, b, w = at(F.floor(position)), at(F.ceil(position)), F.max(position - F.floor(position))
        picks.append((a + (b - a) * w).alias(name))
    return ranked.groupBy(*keys).agg(*picks)
