"""Positions, running sums and rolling windows over sequences of any length.

A plain window puts a whole key into one task. These cut every key into blocks of bounded length, work inside the blocks in
parallel, and carry over what the blocks before contribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.session import materialize


def with_position(df: DataFrame, order: list[Column], position: str = "position") -> DataFrame:
    """0-based position of every row in the global order.

    One range sort, whose result is written once so that positions cannot shift on a re-run; the rows per sort partition then
    give each partition its offset. That offset table has one row per partition, hence the broadcast.
    """
    numbered = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    stored = materialize(numbered, "positions").withColumn("_part", F.shiftright("_mid", 33))
    sizes = stored.groupBy("_part").agg(F.max("_mid").alias("_last"))
    size = F.col("_last").bitwiseAND((1 << 33) - 1) + 1
    before = F.sum(size).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    joined = stored.join(F.broadcast(offsets), "_part")
    return joined.withColumn(position, F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid", "_part", "_offset")


def with_key_position(df: DataFrame, keys: list[str], order: list[Column], position: str = "position") -> DataFrame:
    """0-based position of every row inside its key; a key may span any number of tasks."""
    placed = with_position(df, [F.col(k) for k in keys] + order, "_global")
    starts = placed.groupBy(*keys).agg(F.min("_global").alias("_start"))
    same = [placed[k].eqNullSafe(starts[k]) for k in keys]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    joined = placed.join(starts, condition)
    for k in keys:
        joined = joined.drop(starts[k])
    return joined.withColumn(position, F.col("_global") - F.col("_start")).drop("_global", "_start")


def running_sum(df: DataFrame, keys: list[str], position: str, value: str, out: str, block: int = 4096, levels: int = 2) -> DataFrame:
    """Sum of ``value`` up to and including each row, per key in order of an integer ``position`` unique inside the key.

    Sums inside blocks of ``block`` positions, plus the sum of the blocks before, itself found the same way on one row per
    block. With two levels a key of 10^11 rows leaves a final sequence of a few thousand rows.
    """
    if levels == 0:
        window = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(window))
    cell, total, upto, before, inside = (f"_{name}{levels}" for name in ("block", "total", "upto", "before", "inside"))
    cut = df.withColumn(cell, F.floor(F.col(position) / F.lit(block)))
    window = Window.partitionBy(*keys, cell).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, cell).agg(F.sum(value).alias(total))
    carried = running_sum(totals, keys, cell, total, upto, block, levels - 1)
    carried = carried.select(*keys, cell, (F.col(upto) - F.col(total)).alias(before))
    summed = cut.withColumn(inside, F.sum(value).over(window)).join(carried, [*keys, cell])
    return summed.withColumn(out, F.col(inside) + F.col(before)).drop(cell, inside, before)


def rolling_rows(df: DataFrame, keys: list[str], position: str, rows: int, aggregates: dict[str, Column], block: int = 8192) -> DataFrame:
    """Aggregates over the last ``rows`` rows (this one included) of each key, by integer position.

    Each block also receives copies of the ``rows - 1`` rows before it, so blocks are independent of each other.
    """
    home = F.floor(F.col(position) / F.lit(block))
    last_touched = F.floor((F.col(position) + F.lit(rows - 1)) / F.lit(block))
    copied = df.withColumns({"_home": home, "_block": F.explode(F.sequence(home, last_touched))})
    window = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-(rows - 1), 0)
    done = copied.withColumns({name: agg.over(window) for name, agg in aggregates.items()})
    return done.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def rolling_counts(df: DataFrame, keys: list[str], ts: str, seconds: int, out: str) -> DataFrame:
    """Rows of the trailing ``seconds`` (both ends included) of each key, on every row.

    Rows are first counted per second, map-side, so a burst is one number per second; the window runs over those.
    """
    at = df.withColumn("_second", F.unix_seconds(F.col(ts).cast("timestamp")))
    counts = at.groupBy(*keys, "_second").agg(F.count("*").alias("_n")).withColumn("_moment", F.timestamp_seconds("_second"))
    rolled = rolling_seconds(counts, keys, "_moment", seconds, {out: F.sum("_n")}).select(*keys, "_second", out)
    return at.join(rolled, [*keys, "_second"]).drop("_second")


def rolling_seconds(df: DataFrame, keys: list[str], ts: str, seconds: int, aggregates: dict[str, Column], block: int | None = None) -> DataFrame:
    """Aggregates over the trailing ``seconds`` (both ends included) of each key, cut into time blocks in the same way."""
    width = block or max(12 * seconds, 3600)
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    home = F.floor(at / F.lit(width))
    copied = df.withColumn("_at", at).withColumns({"_home": home, "_block": F.explode(F.sequence(home, F.floor((at + seconds) / F.lit(width))))})
    window = Window.partitionBy(*keys, "_block").orderBy("_at").rangeBetween(-seconds, 0)
    done = copied.withColumns({name: agg.over(window) for name, agg in aggregates.items()})
    return done.filter(F.col("_home") == F.col("_block")).drop("_home", "_block", "_at")
