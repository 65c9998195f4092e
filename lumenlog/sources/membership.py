"""Which ids a table may hold, as bitmaps by day.

An id sets one bit of its day's bitmap, which is kept in pieces of 32 768 bits. An id whose bit is not set is certainly not stored.
The others are settled by an exact join, which then moves few ids instead of all that are stored. The bits of a day, ten times the
ids it may get, are chosen when the bitmaps are made; a day with more ids answers "may be" more and more often, which costs what the
plain join would and changes no result.

Bits are written before the rows they stand for, so a failure in between leaves a bit too many, never one too few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the bits of a day, where the caller does not say.
DAY_BITS = 20


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("day date, piece bigint, bits binary, log2 int").parquet(path)


def _spot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.expr("shiftleft(CAST(1 AS BIGINT), log2)"))


def add(ids: DataFrame, path: str, key: str, day: str, log2: int) -> None:
    """Set the bits of ``ids``; bits that are set stay set, so doing it again changes nothing."""
    spots = ids.withColumn("log2", F.lit(log2)).select(F.col(day).alias("day"), "log2", _spot(key).alias("spot"))
    bits = spots.groupBy("log2", "day", F.bitmap_bucket_number("spot").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    bits.write.mode("append").partitionBy("log2").parquet(path)


def size(spark: SparkSession, path: str) -> int | None:
    """log2 of the bits of a day, as the name of the folder says; none if there are no bitmaps yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(f.getPath().getName()) for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n.removeprefix("log2=")) for n in names if n.startswith("log2=")), default=None)


def may_hold(spark: SparkSession, path: str, ids: DataFrame, key: str, day: str, days: Column, log2: int) -> DataFrame:
    """The rows of ``ids`` whose bit is set; ``days`` limits the stored days (column ``day``) that are read."""
    pieces = _stored(spark, path).filter((F.col("log2") == log2) & days).groupBy("day", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
    asked = ids.withColumn("log2", F.lit(log2)).withColumn("_spot", _spot(key))
    asked = asked.withColumns({"_piece": F.bitmap_bucket_number("_spot"), "_bit": F.bitmap_bit_position("_spot")})
    met = asked.join(pieces, asked["_piece"].eqNullSafe(pieces["piece"]) & asked[day].eqNullSafe(pieces["day"]))
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(_bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*[asked[c] for c in ids.columns])
