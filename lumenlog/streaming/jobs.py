"""Incremental jobs: file and message streams, alerts, de-duplication, dual writes, dead letters.

Every job is a streaming query with its own checkpoint, started with ``availableNow`` so that the same code serves a
scheduled run and, with another trigger, a continuous one. Sinks write one folder per batch id and replace it on a retry,
so a restarted batch leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.contracts import ERROR_SEVERITIES
from lumenlog.functions.columns import count_if
from lumenlog.operators import chat, normalize
from lumenlog.sources import merge_table
from lumenlog.sources.io import routes, table_exists

LOOKBACK = "2 hours"


def stream_files(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A growing folder of Parquet files (or one table path) as a stream; a batch may be bounded by a number of files."""
    if path.endswith(".parquet"):
        path = f"{path[:-1]}[{path[-1]}]"  # a pattern: the source takes a single file only that way
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_to_completion(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available with ``each(batch, batch_id)``, then stop."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    )
    query.awaitTermination()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is new to a table; a second run adds only rows that arrived since."""
    run_to_completion(stream, lambda batch, batch_id: _write_batch(batch, path, batch_id), checkpoint)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of an append sink; empty when nothing has arrived yet."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], full)


def latest_updates(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Newest value per key of a sink that received updates."""
    rows = read_batches(spark, path, schema)
    rest = [c for c in schema.fieldNames() if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_row"))
    return newest.select(*keys, "_row.*")


# --- incremental tables -----------------------------------------------------------------------------------------------


def lookback_rows(source: DataFrame, target: DataFrame, start: str, ts: str, key: str) -> DataFrame:
    """Rows since ``start`` that the target lacks: an overlapping re-scan that adds each row once.

    Both sides are cut to the window before the anti join, so its cost follows the window, not the table.
    """
    since = F.lit(start).cast(source.schema[ts].dataType)
    stored = target.filter(F.col(ts) >= since).select(key)
    return source.filter(F.col(ts) >= since).join(stored, key, "left_anti")


def dedup_within_watermark(stream: DataFrame, ts: str, keys: list[str], delay: str = LOOKBACK) -> DataFrame:
    """First row per key among those no further apart than the watermark; older state is forgotten."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


# --- messages ---------------------------------------------------------------------------------------------------------


def decode_messages(stream: DataFrame, data: str = "data") -> DataFrame:
    """Base64 message bodies as JSON text."""
    return stream.withColumn("payload", F.decode(F.unbase64(data), "UTF-8"))


def consume_messages(stream: DataFrame, chat_path: str, tool_path: str, checkpoint: str, attribute: str = "attribute_event_type") -> None:
    """Route decoded messages to the chat or tool table. Each sink reads the batch from the source; nothing is cached."""

    def each(batch: DataFrame, batch_id: int) -> None:
        tools, chats = chat.route_events(batch, attribute, "payload")
        _write_batch(chat.chat_event_rows(chats), chat_path, batch_id)
        _write_batch(tools.select("event_id", "payload"), tool_path, batch_id)

    run_to_completion(decode_messages(stream), each, checkpoint)


def critical_alerts(rows: DataFrame) -> DataFrame:
    """Rows that page somebody."""
    return rows.filter(F.col("severity").isin("CRITICAL", "ALERT"))


def route_by_severity(stream: DataFrame, paths: dict[str, str], checkpoint: str, level: Column) -> None:
    """One query feeds the analytics, archive and alert tables."""
    def each(batch: DataFrame, batch_id: int) -> None:
        for name, rows in routes(batch.withColumn("severity_level", level)).items():
            _write_batch(rows, paths[name], batch_id)

    run_to_completion(stream, each, checkpoint)


# --- windowed alerts --------------------------------------------------------------------------------------------------


def windowed_rates(rows: DataFrame, ts: str, size: str, slide: str | None = None, delay: str = LOOKBACK) -> DataFrame:
    """Rows, errors and server errors per tumbling or sliding window; works on a stream and, without the watermark, on a table.

    Counts combine map-side, so a burst in one window does not pile up in one task.
    """
    windowed = rows.withWatermark(ts, delay) if rows.isStreaming else rows.filter(F.col(ts).isNotNull())
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = windowed.groupBy(window.alias("w")).agg(
        F.count("*").alias("entries"),
        count_if(F.col("severity").isin(ERROR_SEVERITIES)).alias("errors"),
        F.sum(F.octet_length("message")).alias("bytes"),
    )
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "entries", "errors", "bytes")


def fired(rates: DataFrame, column: str, threshold: float) -> DataFrame:
    return rates.withColumn("fired", F.col(column) > threshold)


def run_windowed(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the current value of every window in an update sink."""
    run_to_completion(stream, lambda batch, batch_id: _write_batch(batch, path, batch_id), checkpoint, mode="update")


# --- dual writes and dead letters -------------------------------------------------------------------------------------


def dual_write(
    log_stream: DataFrame, state_stream: DataFrame, state_path: str, log_path: str, checkpoint: str, key: str, order: str, buckets: int = 64, most_deltas: int = 16
) -> Exception | None:
    """Append every event to the log and keep the latest event per key, as two queries over the same source.

    Each query has its own checkpoint, so neither waits for the other: if the state cannot be written, the log still receives
    this and all later batches, and the state catches up from its own checkpoint once it can. Returns what stopped the state.
    The state is a merge table: a batch writes its own rows only, and every ``most_deltas`` batches are folded in; read it with
    ``merge_table.read``.
    """
    append_stream(log_stream, log_path, f"{checkpoint}/log")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merge_table.upsert(batch, state_path, key, order, batch_id, "stream", buckets=buckets)
        if len(merge_table.manifest(spark, state_path)["deltas"]) >= most_deltas:
            merge_table.compact(spark, state_path, key, order)

    try:
        run_to_completion(state_stream, each, f"{checkpoint}/state")
    except StreamingQueryException as e:
        return e
    return None


def split_retries(jobs: DataFrame, max_retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(failed jobs to queue again, dead letters)"""
    failed = jobs.filter(F.col("status") == "FAILED").withColumn("retry_count", F.col("retry_count") + 1)
    return failed.filter(F.col("retry_count") < max_retries), failed.filter(F.col("retry_count") >= max_retries)


def redrive(dead: DataFrame, to_priority: bool = False) -> DataFrame:
    """Dead letters back into the queue with a fresh retry budget."""
    return dead.withColumns({"retry_count": F.lit(0), "priority": F.lit(to_priority), "status": F.lit("QUEUED")})


def queue_stats(jobs: DataFrame) -> DataFrame:
    pending = F.col("status").isin("RUNNING", "QUEUED", "PARTIAL")
    return jobs.agg(
        count_if(pending & F.col("priority")).alias("priority"),
        count_if(pending & ~F.col("priority")).alias("backlog"),
        count_if(F.col("status") == "FAILED").alias("failed"),
        count_if(pending).alias("total_pending"),
    )


def global_progress(batches: DataFrame) -> DataFrame:
    """Per source the newest offset and total, and under a null source the grand total."""
    order = F.struct("started_at", "seq")
    per_source = batches.groupBy("stream_id").agg(
        F.max_by("seq", order).alias("last_offset"),
        F.sum("total_loaded").alias("total_loaded"),
        F.max_by("status", order).alias("last_status"),
    )
    grand = per_source.agg(
        F.lit(None).cast("string").alias("stream_id"),
        F.max("last_offset").alias("last_offset"),
        F.sum("total_loaded").alias("total_loaded"),
        F.concat(count_if(F.col("last_status") == "COMPLETED"), F.lit(" sources completed")).alias("last_status"),
    )
    return per_source.unionByName(grand)


def error_embeddings(stream: DataFrame, path: str, checkpoint: str, dim: int) -> None:
    """Embed the alert text of high-severity rows as they arrive."""
    from lumenlog.operators.textprep import embed

    def each(batch: DataFrame, batch_id: int) -> None:
        texts = normalize.alert_messages(normalize.payload_columns(normalize.parse_record(batch)))
        _write_batch(embed(texts.select("log_id", "alert_text"), "alert_text", dim), path, batch_id)

    run_to_completion(stream, each, checkpoint)
