"""Shards by jump consistent hashing: a key and the number of shards decide, without a ring table.

When a shard is appended, a key either stays where it is or moves to the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.ordered import with_key_position
from lumenlog.session import materialize

# The generator of the published jump hash (Lamping and Veach, 2014).
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key, all keys at once; the loop runs about ln(shards) times."""
    state = keys.astype(np.uint64)
    last = np.full(len(state), -1, np.int64)
    following = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        last[moving] = following[moving]
        state[moving] = state[moving] * MULTIPLIER + np.uint64(1)
        span = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        following[moving] = np.floor((last[moving] + 1) * (float(1 << 31) / span)).astype(np.int64)
        moving = moving[following[moving] < shards]
    return last


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a bigint key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.coalesce(key.cast("bigint"), F.lit(0)))


def place_in_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard, its slot there (gapless from 0, in order of id), and the shard it would have with one shard more.

    ``size`` is the text's UTF-8 bytes plus 1 and ``text_crc32`` its checksum; a null text has no bytes. A null id hashes as 0 and
    comes first in its shard; rows that repeat an id share its shard and follow each other by size and checksum. Only the two
    named columns are read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialize(rows.withColumns({"shard": shard_of(F.col("id"), shards), "grown_shard": shard_of(F.col("id"), shards + 1)}), "shards")
    placed = with_key_position(rows, ["shard"], [F.col("id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], "slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")
