"""Reading raw sinks, and writing, upserting, expiring and routing log tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.contracts import (
    ERROR_LEVEL,
    LOG_MARKER_FIELDS,
    RAW_CONTEXT_FIELDS,
    RAW_CORE_FIELDS,
    RAW_PAYLOAD_FIELDS,
    RETENTION_DAYS,
)
from lumenlog.functions.columns import col, contains_any, first_present, literal_like
from lumenlog.functions.ids import natural_key
from lumenlog.functions.timewin import since
from lumenlog.session import materialize
from lumenlog.sources import membership

#: Rows of a piece that a load sorts and writes, and those that are worth a piece of their own while cores are idle.
PIECE_ROWS, LEAST_ROWS = 1 << 17, 1 << 12

# --- raw sinks --------------------------------------------------------------------------------------------------------


def scan_source(df: DataFrame, as_of: str | None = None, hours: float | None = None) -> DataFrame:
    """Only the known fields the table really has, optionally only the last hours. Both reach the file scan."""
    wanted = [c for c in RAW_CORE_FIELDS + RAW_PAYLOAD_FIELDS + RAW_CONTEXT_FIELDS if c in df.columns]
    rows = df if hours is None else df.filter(since(df, "timestamp", as_of, hours=hours))
    return rows.select(*wanted)


def _as_json(df: DataFrame, column: str) -> Column:
    """A payload as JSON text, whatever its type; null where the table lacks it."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    kind = df.schema[column].dataType
    return F.col(column) if isinstance(kind, T.StringType) else F.to_json(column)


def _or_null(df: DataFrame, column: str, kind: str) -> Column:
    return F.col(column).cast(kind) if column in df.columns else F.lit(None).cast(kind)


def stream_direction(table: str | Column) -> Column:
    t = F.lower(col(table))
    return (
        F.when(t.contains("audit"), "INTERNAL").when(t.contains("request"), "INBOUND").when(t.contains("sink_error"), "OUTBOUND").otherwise("INTERNAL")
    )


def stream_flow(table: str | Column) -> Column:
    return F.when(contains_any(F.lower(col(table)), ["stdout", "stderr"]), "REALTIME").otherwise("BATCH")


def stream_name(table: str | Column) -> Column:
    return F.replace(F.replace(col(table), F.lit("_googleapis_com_"), F.lit(":")), F.lit("_"), F.lit("-"))


def derive_streams(df: DataFrame, dataset: str, table: str = "source_table") -> DataFrame:
    """Stream identity, direction and flow of each source table name."""
    return df.select(table).distinct().select(
        F.concat(F.lit(f"{dataset}."), table).alias("stream_id"),
        stream_name(table).alias("stream_name"),
        F.lit(dataset).alias("source_dataset"),
        F.col(table).alias("source_table"),
        stream_direction(table).alias("stream_direction"),
        stream_flow(table).alias("stream_flow"),
    )


def to_raw_record(df: DataFrame, dataset: str, table: str) -> DataFrame:
    """A raw sink row as the record the normaliser reads.

    The row id is a hash of the natural key, so reading the same row again gives the same id.
    """
    has_resource = "resource" in df.columns
    resource = df.schema["resource"].dataType if has_resource else None
    labels = F.to_json("resource.labels") if has_resource and "labels" in resource.fieldNames() else F.lit(None).cast("string")
    kind = F.col("resource.type") if has_resource and "type" in resource.fieldNames() else F.lit(None).cast("string")
    source = F.lit(table)
    text = _or_null(df, "textPayload", "string")
    payloads = [_as_json(df, c) for c in ("jsonPayload", "protoPayload", "protopayload_auditlog", "httpRequest")]
    key = [F.lit(f"{dataset}.{table}"), _or_null(df, "insertId", "string"), F.col("timestamp"), _or_null(df, "spanId", "string"), text, *payloads]
    return df.select(
        natural_key(*key).alias("log_id"),
        _or_null(df, "insertId", "string").alias("insert_id"),
        F.col("timestamp").alias("event_timestamp"),
        _or_null(df, "receiveTimestamp", "timestamp").alias("receive_timestamp"),
        F.coalesce(_or_null(df, "severity", "string"), F.lit("DEFAULT")).alias("severity"),
        _or_null(df, "logName", "string").alias("source_log_name"),
        F.lit(dataset).alias("source_dataset"),
        source.alias("source_table"),
        F.lit(f"{dataset}.{table}").alias("stream_id"),
        stream_direction(source).alias("stream_direction"),
        stream_flow(source).alias("stream_flow"),
        F.coalesce(kind, F.lit("unknown")).alias("resource_type"),
        labels.alias("resource_labels"),
        text.alias("text_payload"),
        _as_json(df, "jsonPayload").alias("json_payload"),
        _as_json(df, "protoPayload").alias("proto_payload"),
        _as_json(df, "protopayload_auditlog").alias("audit_payload"),
        _as_json(df, "httpRequest").alias("http_request"),
        _or_null(df, "trace", "string").alias("trace"),
        _or_null(df, "spanId", "string").alias("span_id"),
        _or_null(df, "traceSampled", "boolean").alias("trace_sampled"),
        _as_json(df, "operation").alias("operation"),
        _as_json(df, "sourceLocation").alias("source_location"),
        _as_json(df, "labels").alias("labels"),
    )


def discover_streams(tables: dict[str, DataFrame], dataset: str) -> DataFrame:
    """Tables that look like logs and hold rows, with row count and field list.

    The choice by schema is metadata only; the counts are one union of per-table counts, so they run as one job.
    """
    logs = {name: df for name, df in tables.items() if any(f in df.columns for f in LOG_MARKER_FIELDS)}
    counts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("source_table"), "row_count", F.lit(",".join(sorted(df.columns))).alias("schema_fields")
        )
        for name, df in sorted(logs.items())
    ]
    found = reduce(DataFrame.unionByName, counts).filter(F.col("row_count") > 0)
    return found.select(
        F.concat(F.lit(f"{dataset}."), "source_table").alias("stream_id"),
        "source_table",
        stream_direction("source_table").alias("stream_direction"),
        stream_flow("source_table").alias("stream_flow"),
        "row_count",
        "schema_fields",
    )


def union_sharded(parts: list[DataFrame]) -> DataFrame:
    """Date-sharded tables read as one; a column some shard lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_sharded(spark: SparkSession, pattern: str) -> DataFrame:
    """All shards matching a path pattern, their schemas merged."""
    return spark.read.option("mergeSchema", "true").parquet(pattern)


# --- staging ----------------------------------------------------------------------------------------------------------


def load_staging_json(spark: SparkSession, path: str, fetched_at: str, type_field: str = "assetType") -> DataFrame:
    """Lines of JSON objects, or of one JSON array, as staging rows with an opaque payload."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    one = F.regexp_replace(F.trim("value"), r"^\[\s*|,\s*$|\s*\]$", "")
    payload = lines.select(one.alias("payload")).filter(F.col("payload").startswith("{"))
    return staging_rows(payload, fetched_at, type_field)


def load_staging_array(spark: SparkSession, path: str, fetched_at: str, type_field: str = "assetType") -> DataFrame:
    """Files that each hold one JSON array of objects."""
    objects = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<variant>")).alias("v"))
    return staging_rows(objects.select(F.to_json("v").alias("payload")), fetched_at, type_field)


def staging_rows(payload: DataFrame, fetched_at: str, type_field: str = "assetType") -> DataFrame:
    kind = F.coalesce(F.get_json_object("payload", f"$.{type_field}"), F.lit("unknown"))
    return payload.select(F.lit(fetched_at).cast("timestamp").alias("fetched_at"), kind.alias("asset_type"), "payload")


def append_staging(df: DataFrame, path: str) -> None:
    """Append; new fields are allowed and appear as nulls in old rows."""
    df.write.mode("append").parquet(path)


def latest_export(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Paths of all files of the newest export. Lists the folder only; file contents are not read.

    Files belong to one export when their paths differ only in the number of the part.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    if prefix:
        files = files.filter(F.element_at(F.split("path", "/"), -1).startswith(prefix))
    files = files.withColumn("export", F.regexp_replace("path", r"part-\d+|\d+-of-\d+|\d{12}(?=\.[^/]*$)", "*"))
    newest = files.groupBy("export").agg(F.max("modificationTime").alias("at")).orderBy(F.desc("at"), F.desc("export")).limit(1)
    return sorted(r["path"] for r in files.join(F.broadcast(newest), "export").select("path").collect())


# --- the unified table ------------------------------------------------------------------------------------------------


def loadable(df: DataFrame, batch_id: str, loaded_at: str, version: str = "1.0.0") -> DataFrame:
    """Unified rows as they are stored: whole texts, load metadata, partition date and cluster key."""
    return df.withColumns(
        {
            "etl_timestamp": F.lit(loaded_at).cast("timestamp"),
            "etl_version": F.lit(version),
            "etl_batch_id": F.lit(batch_id),
            "etl_status": F.lit("SUCCESS"),
            "etl_enrichments": F.array(F.lit("normalized"), F.lit("classified"), F.lit("envelope")),
            "log_date": F.to_date("event_timestamp"),
            "cluster_key": F.concat("severity", F.lit(":"), F.coalesce("service_name", F.lit("unknown"))),
        }
    )


def write_clustered(df: DataFrame, path: str, partition: str, cluster: list[str], mode: str = "append", placed: bool = False) -> None:
    """Partition and cluster layout.

    Rows are rebalanced by partition value: adaptive execution cuts a day that holds a large share of the rows into files of
    the advisory size and merges small days, with no sampling pass over the input. Sorting inside the files gives their row
    groups narrow min/max bounds on the cluster keys. Rows that lie by partition value in pieces of bounded size (``placed``) stay there.
    """
    rows = df if placed else df.hint("rebalance", partition)
    rows.sortWithinPartitions(partition, *cluster).write.mode(mode).partitionBy(partition).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``; any other trouble with reading it is raised, not taken for absence."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def append_logs(
    df: DataFrame, path: str, batch_id: str, loaded_at: str, extracted: Observation | None = None, loaded: Observation | None = None, counts: list[Column] | None = None,
    id_bits: int = membership.DAY_BITS, shape: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Append rows whose id is not stored yet; running it twice changes nothing.

    An id belongs to one day, as it is a hash of what the row is, its time included. Bitmaps of the stored ids, by day and beside the
    table, tell which ids of the batch may be stored already. Only these meet the stored ids, of the days between the batch's first
    and last one and of the partition without a date. The observations get ``counts`` of the rows that came, from the pass over their
    ids, and of those that were added, from the one that writes. ``id_bits`` is log2 of the bits of a day's bitmap in a table that has
    none yet. ``shape`` makes the stored rows, one of each row.

    Rows are moved once, as they come and before ``shape`` widens them, into pieces by day and id, of a bounded number of rows. There
    they meet the ids that are stored and their own copies, take their shape, are sorted and written.
    """
    spark, known = df.sparkSession, f"{path.rstrip('/')}_ids"
    rows = df.withColumn("log_date", F.to_date("event_timestamp"))
    came = rows if extracted is None else rows.observe(extracted, *counts)
    ids = materialize(came.select("log_id", "log_date"), "batch-ids")
    rows = rows.withColumn("_stored", F.lit(False))
    log2 = membership.size(spark, known)
    if table_exists(spark, path):
        stored = spark.read.parquet(path).select("log_id", "log_date")
        if log2 is None:
            log2 = id_bits
            membership.add(stored, known, "log_id", "log_date", log2)
        span = ids.agg(F.min("log_date").alias("first"), F.max("log_date").alias("last")).first()

        def held(day: str) -> Column:
            return F.col(day).isNull() if span["first"] is None else F.col(day).between(span["first"], span["last"]) | F.col(day).isNull()

        suspects = membership.may_hold(spark, known, ids, "log_id", "log_date", held("day"), log2)
        present = materialize(suspects.join(stored.filter(held("log_date")).select("log_id"), "log_id", "left_semi").distinct(), "stored-ids")
        rows = rows.unionByName(present.withColumn("_stored", F.lit(True)), allowMissingColumns=True)
    membership.add(ids, known, "log_id", "log_date", log2 or id_bits)  # bits of stored ids are set already
    size = ids.count()
    wanted = max(1, -(-size // PIECE_ROWS), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_ROWS)))
    by = [F.col("_day"), F.col("log_id")]
    placed = rows.withColumn("_day", F.when(F.col("log_id").isNotNull(), F.col("log_date"))).repartitionByRange(wanted, *by)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_stored")))
    fresh = placed.withColumn("_nth", nth).filter("_nth = 1 AND NOT _stored").drop("_nth", "_stored", "_day")
    batch = loadable(fresh if shape is None else shape(fresh), batch_id, loaded_at)
    if loaded is not None:
        batch = batch.observe(loaded, *counts)
    write_clustered(batch, path, "log_date", ["severity", "service_name", "resource_type"], placed=True)


def keyed_upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins per key: the highest order, then a change before what is stored, then the row's hash.

    An aggregate rather than a window: tasks keep one row per key before the shuffle, so many copies of one key stay cheap.
    """
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "_new", F.xxhash64(*rest))).alias("_row"))
    return latest.select(key, "_row.*").select(*target.columns)


def upsert_table(spark: SparkSession, path: str, changes: DataFrame, key: str, order: str, buckets: int = 64) -> None:
    """Write ``changes`` into the keyed table at ``path``; only the buckets they fall into are rewritten.

    The number of buckets is part of the table's layout: it is chosen when the table is made, from then on the stored number
    counts, and ``rebucket`` changes it. Buckets are rewritten from a stored copy, so a failure half-way leaves an old bucket or a
    new one, and the same changes again change nothing.
    """
    stored = spark.read.parquet(path) if table_exists(spark, path) else None
    if stored is not None:
        buckets = stored.agg(F.max("buckets")).first()[0]
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    rows = changes.withColumns({"buckets": F.lit(buckets), "bucket": bucket})
    if stored is not None:
        touched = rows.select("bucket").distinct()
        old = stored.join(F.broadcast(touched), "bucket", "left_semi").select(*rows.columns)  # at most one row per bucket
    else:
        old = rows.limit(0)
    merged = materialize(keyed_upsert(old, rows, key, order), "upsert")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(path)


def rebucket(spark: SparkSession, path: str, target: str, key: str, buckets: int) -> None:
    """A copy of a keyed table with another number of buckets, for one that has outgrown them."""
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    rows = spark.read.parquet(path).withColumns({"buckets": F.lit(buckets), "bucket": bucket})
    rows.hint("rebalance", "bucket").write.partitionBy("buckets", "bucket").parquet(target)


def drop_partitions(spark: SparkSession, path: str, partition: str, values: list) -> None:
    """Remove whole partitions of a table from its store."""
    jvm = spark._jvm
    for value in values:
        name = "__HIVE_DEFAULT_PARTITION__" if value is None else jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete_where(spark: SparkSession, path: str, partition: str, condition: Column, dry_run: bool = False) -> DataFrame:
    """Delete the rows of a partitioned table that meet ``condition``: partitions without survivors go, mixed ones are rewritten.

    Returns rows and deleted rows of each partition that is touched (with ``dry_run``, that would be). A condition that is null
    keeps the row. Only the columns of the condition are read to find the partitions, and only mixed partitions are rewritten,
    from a stored copy.
    """
    table = spark.read.parquet(path)
    gone = F.coalesce(condition, F.lit(False))
    counts = table.groupBy(partition).agg(F.count("*").alias("rows"), F.sum(gone.cast("bigint")).alias("deleted")).filter("deleted > 0")
    counts = materialize(counts, "deleted")
    if dry_run:
        return counts
    mixed = counts.filter("deleted < rows").select(F.col(partition).alias("_mixed"))  # one row per partition
    kept = table.filter(~gone).join(F.broadcast(mixed), F.col(partition).eqNullSafe(F.col("_mixed")), "left_semi")
    overwrite_partitions(materialize(kept, "kept"), path, partition)
    drop_partitions(spark, path, partition, [r[0] for r in counts.filter("deleted = rows").select(partition).collect()])
    spark.catalog.refreshByPath(path)
    return counts


def delete_tenant(spark: SparkSession, path: str, tenant: str, column: str = "project_id") -> DataFrame:
    """Delete one tenant from a table partitioned by tenant."""
    return delete_where(spark, path, column, F.col(column) == tenant)


def expire(spark: SparkSession, path: str, table: str, date: str, partition: str, as_of: str) -> DataFrame:
    """Delete what has outlived the table's retention."""
    return delete_where(spark, path, partition, F.col(date) < F.date_sub(F.to_date(F.lit(as_of[:10])), RETENTION_DAYS[table]))


def cleanup(spark: SparkSession, path: str, before: str, partition: str, ts: str = "event_timestamp", dry_run: bool = False) -> DataFrame:
    """Delete rows older than a moment; rows without a timestamp stay."""
    return delete_where(spark, path, partition, F.col(ts) < F.lit(before).cast("timestamp"), dry_run)


def without_tenant(df: DataFrame, tenant: str, column: str = "project_id") -> DataFrame:
    """Everything but one tenant's rows."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(tenant)))


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def unexpired(df: DataFrame, table: str, date: str, as_of: str) -> DataFrame:
    """Rows inside the table's retention; a filter on the partition column, so expired partitions are never read."""
    return df.filter(F.col(date) >= F.date_sub(F.to_date(F.lit(as_of[:10])), RETENTION_DAYS[table]))


def older_than(df: DataFrame, before: str, ts: str = "event_timestamp") -> DataFrame:
    """What a clean-up would delete."""
    return df.filter(F.col(ts) < literal_like(df, ts, before))


def survivors(df: DataFrame, before: str, ts: str = "event_timestamp") -> DataFrame:
    """What a clean-up keeps; rows without a timestamp are kept."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= literal_like(df, ts, before)))


def routes(df: DataFrame, level: str = "severity_level") -> dict[str, DataFrame]:
    """Where rows go by severity: INFO and above to analytics and archive, ERROR and above to alerts."""
    info = df.filter(F.col(level) >= 200)
    return {"analytics": info, "archive": info, "alerts": df.filter(F.col(level) >= ERROR_LEVEL)}


def backfill(records: DataFrame, as_of: str, hours: float, limit: int) -> DataFrame:
    """The oldest rows of the window that have content, as work items for embedding."""
    content = first_present("text_payload", "json_payload", "proto_payload")
    rows = records.filter(since(records, "event_timestamp", as_of, hours=hours)).withColumn("content", content)
    return (
        rows.filter(F.col("content").isNotNull())
        .orderBy("event_timestamp", "log_id")
        .limit(limit)
        .select(
            "log_id",
            "stream_id",
            first_present("service_name", F.lit("unknown-service")).alias("service"),
            F.coalesce("severity", F.lit("DEFAULT")).alias("severity"),
            F.col("event_timestamp").alias("timestamp"),
            "content",
        )
    )
