"""Named queries: sources, sinks and table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.timewin import EVENTS_AS_OF as AS_OF
from lumenlog.operators.normalize import severity_level
from lumenlog.plans.oracle_views import level_sql
from lumenlog.plans.registry import query
from lumenlog.plans.shapes import raw_sink
from lumenlog.session import scratch_path
from lumenlog.sources import io
from lumenlog.sources import merge_table as mt


@query(
    "scan_source",
    """SELECT ts AS timestamp, severity, insert_id AS "insertId", log_name AS "logName", receive_ts AS "receiveTimestamp", trace, span_id AS "spanId", trace_sampled AS "traceSampled",
       text_payload AS "textPayload", resource_type, build_id FROM raw_flat WHERE sink_kind = 'signup' AND ts >= TIMESTAMP '2024-01-01 00:00:00'""",
)
def _(c):
    rows = io.scan_source(raw_sink(c, "build"), AS_OF, 720)
    return rows.select("*", F.col("resource.type").alias("resource_type"), F.col("resource.labels.build_id").alias("build_id")).drop("resource")


@query(
    "to_raw_record",
    """SELECT insert_id, ts AS event_timestamp, coalesce(severity, 'DEFAULT') AS severity, log_name AS source_log_name, 'logs_v1.cloudaudit_data_access' AS stream_id,
       'INTERNAL' AS stream_direction, 'BATCH' AS stream_flow, coalesce(resource_type, 'unknown') AS resource_type, audit_service, method_name, project_id, trace, span_id, trace_sampled
       FROM raw_flat WHERE sink_kind = 'purchase'""",
)
def _(c):
    rows = io.to_raw_record(raw_sink(c, "data_access"), "logs_v1", "cloudaudit_data_access")
    audit = F.from_json("audit_payload", "serviceName string, methodName string")
    labels = F.from_json("resource_labels", "map<string,string>")
    return rows.select(
        "insert_id", "event_timestamp", "severity", "source_log_name", "stream_id", "stream_direction", "stream_flow", "resource_type",
        audit["serviceName"].alias("audit_service"), audit["methodName"].alias("method_name"), labels["project_id"].alias("project_id"),
        "trace", "span_id", "trace_sampled",
    )


@query(
    "discover_streams",
    """SELECT 'logs_v1.' || sink AS stream_id, sink AS source_table, CASE WHEN sink = 'requests' THEN 'INBOUND' ELSE 'INTERNAL' END AS stream_direction,
       CASE WHEN sink IN ('stdout', 'stderr') THEN 'REALTIME' ELSE 'BATCH' END AS stream_flow, count(*) AS row_count
       FROM raw_flat JOIN (VALUES ('requests', 'click'), ('stdout', 'view'), ('stderr', 'error'), ('activity', 'purchase'), ('build', 'signup')) AS k(sink, kind) ON sink_kind = kind GROUP BY ALL""",
)
def _(c):
    tables = {name: raw_sink(c, name) for name in ("requests", "stdout", "stderr", "activity", "build")}
    return io.discover_streams(tables | {"documents": c.documents}, "logs_v1").drop("schema_fields")


@query(
    "derive_streams",
    """SELECT DISTINCT 'logs_v1.' || source_table AS stream_id, replace(replace(source_table, '_googleapis_com_', ':'), '_', '-') AS stream_name, 'logs_v1' AS source_dataset, source_table,
       CASE WHEN contains(source_table, 'audit') THEN 'INTERNAL' WHEN contains(source_table, 'request') THEN 'INBOUND' ELSE 'INTERNAL' END AS stream_direction,
       CASE WHEN contains(source_table, 'stdout') OR contains(source_table, 'stderr') THEN 'REALTIME' ELSE 'BATCH' END AS stream_flow FROM logs""",
)
def _(c):
    return io.derive_streams(c.logs, "logs_v1")


@query(
    "load_staging_array",
    "SELECT TIMESTAMP '2024-01-30 00:00:00' AS fetched_at, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE 'kind' || s_suppkey % 3 END AS asset_type, s_name AS name, s_nationkey AS nation FROM supplier",
)
def _(c):
    """One file with a JSON array for each nation."""
    path = scratch_path(c.spark, "staging-arrays")
    kind = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("kind"), F.col("s_suppkey") % 3))
    objects = c.supplier.select("s_nationkey", F.struct(kind.alias("assetType"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("o"))
    objects.groupBy("s_nationkey").agg(F.to_json(F.collect_list("o")).alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    rows = io.load_staging_array(c.spark, path, "2024-01-30 00:00:00")
    return rows.select("fetched_at", "asset_type", F.get_json_object("payload", "$.name").alias("name"), F.get_json_object("payload", "$.nation").cast(c.supplier.schema["s_nationkey"].dataType).alias("nation"))


@query(
    "load_staging_json",
    """SELECT TIMESTAMP '2024-01-30 00:00:00' AS fetched_at, coalesce(json_extract_string(payload, '$.assetType'), 'unknown') AS asset_type,
       json_extract_string(payload, '$.name') AS name, json_extract_string(payload, '$.project') AS project FROM
       (SELECT '{"name":"' || s_name || '","project":"proj-' || CAST(s_suppkey % 8 AS STRING) || '"' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ',"assetType":"' || 'kind' || CAST(s_suppkey % 3 AS STRING) || '"' END || '}' AS payload FROM supplier) AS x""",
)
def _(c):
    path = scratch_path(c.spark, "staging")
    lines = c.sql(
        """SELECT '{"name":"' || s_name || '","project":"proj-' || CAST(s_suppkey % 8 AS STRING) || '"' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ',"assetType":"' || 'kind' || CAST(s_suppkey % 3 AS STRING) || '"' END || '}' AS value FROM supplier"""
    )
    lines.write.text(path)
    rows = io.load_staging_json(c.spark, path, "2024-01-30 00:00:00")
    return rows.select("fetched_at", "asset_type", F.get_json_object("payload", "$.name").alias("name"), F.get_json_object("payload", "$.project").alias("project"))


@query("latest_export", "SELECT * FROM supplier")
def _(c):
    path = scratch_path(c.spark, "exports")
    c.supplier.select("s_suppkey").write.mode("append").parquet(path)
    c.supplier.repartition(4, "s_suppkey").write.mode("append").parquet(path)
    return c.spark.read.parquet(*io.latest_export(c.spark, path, "part-"))


@query(
    "append_logs",
    """SELECT log_id, event_timestamp, severity, service_name, message, CAST(event_timestamp AS DATE) AS log_date,
       severity || ':' || coalesce(service_name, 'unknown') AS cluster_key, 'batch-1' AS etl_batch_id FROM logs""",
)
def _(c):
    path = scratch_path(c.spark, "unified-append")
    rows = c.logs.drop("log_date")
    io.append_logs(rows, path, "batch-1", AS_OF)
    io.append_logs(rows, path, "batch-2", AS_OF)  # the same rows again: nothing may change
    return c.spark.read.parquet(path).select("log_id", "event_timestamp", "severity", "service_name", "message", "log_date", "cluster_key", "etl_batch_id")


@query("write_clustered", "SELECT * FROM logs")
def _(c):
    path = scratch_path(c.spark, "clustered")
    io.write_clustered(c.logs.filter(F.col("log_date").isNotNull()), path, "log_date", ["severity", "service_name", "resource_type"])
    return c.spark.read.parquet(path)


@query(
    "upsert_points",
    """WITH u AS (SELECT vec_id, project_id, severity, 1 AS seq FROM vec UNION ALL SELECT vec_id, project_id, 'INFO', 2 FROM vec WHERE severity = 'ERROR'
                  UNION ALL SELECT vec_id + 1000000, project_id, severity, 2 FROM vec WHERE severity = 'WARNING')
       SELECT vec_id, arg_max(project_id, seq) AS project_id, arg_max(severity, seq) AS severity, CAST(max(seq) AS INTEGER) AS seq FROM u GROUP BY vec_id""",
)
def _(c):
    base = c.vec.select("vec_id", "project_id", "severity", F.lit(1).alias("seq"))
    changed = c.vec.filter("severity = 'ERROR'").select("vec_id", "project_id", F.lit("INFO").alias("severity"), F.lit(2).alias("seq"))
    fresh = c.vec.filter("severity = 'WARNING'").select((F.col("vec_id") + 1000000).alias("vec_id"), "project_id", "severity", F.lit(2).alias("seq"))
    path = scratch_path(c.spark, "points")
    mt.upsert(base, path, "vec_id", "seq", 0, buckets=4)
    mt.compact(c.spark, path, "vec_id", "seq")
    for _again in range(2):  # the second time nothing may change
        mt.upsert(changed.unionByName(fresh), path, "vec_id", "seq", 1)
    return mt.read(c.spark, path, "vec_id", "seq")


@query(
    "upsert_and_delete",
    """WITH k AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 <> 1 OR o_orderkey % 3 = 0)
       SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 1 END AS INTEGER) AS seq FROM k""",
)
def _(c):
    """Rows, deletions and late changes over several batches, with a compaction in between."""
    path = scratch_path(c.spark, "orders-state")
    rows = c.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("seq"))
    gone = c.orders.filter("o_orderkey % 4 = 1").select("o_orderkey", F.lit(2).alias("seq"))
    mt.upsert(rows, path, "o_orderkey", "seq", 0, buckets=8)
    mt.upsert(rows.limit(0), path, "o_orderkey", "seq", 1, deletes=gone)
    mt.compact(c.spark, path, "o_orderkey", "seq")
    late = rows.withColumns({"status": F.lit("late"), "seq": F.lit(0)})  # older than what is stored and deleted
    mt.upsert(late, path, "o_orderkey", "seq", 2)
    changed = c.orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("status"), F.lit(3).alias("seq"))
    mt.upsert(changed, path, "o_orderkey", "seq", 3)
    return mt.read(c.spark, path, "o_orderkey", "seq")


@query("delete_by_tenant", "SELECT vec_id, project_id FROM vec WHERE project_id <> 'tenant-1'")
def _(c):
    path = scratch_path(c.spark, "points")
    c.vec.select("vec_id", "project_id").write.partitionBy("project_id").parquet(path)
    io.delete_tenant(c.spark, path, "tenant-1")
    return c.spark.read.parquet(path).select("vec_id", "project_id")


@query(
    "expire_partitions",
    """SELECT 'billing_detailed_current' AS table_name, count(*) AS kept FROM billing WHERE usage_date >= DATE '2001-11-05' - 180
       UNION ALL SELECT 'service_costs_detailed', count(*) FROM billing WHERE usage_date >= DATE '2001-11-05' - 365
       UNION ALL SELECT 'cud_export', count(*) FROM cud WHERE usage_date >= DATE '2001-11-05' - 1095""",
)
def _(c):
    kept = []
    for table, df in (("billing_detailed_current", c.billing), ("service_costs_detailed", c.billing), ("cud_export", c.cud)):
        path = scratch_path(c.spark, "expiring")
        df.select("usage_date", F.date_format("usage_date", "yyyy-MM").alias("usage_month")).write.partitionBy("usage_month").parquet(path)
        io.expire(c.spark, path, table, "usage_date", "usage_month", "2001-11-05")
        kept.append(c.spark.read.parquet(path).agg(F.lit(table).alias("table_name"), F.count("*").alias("kept")))
    return reduce(DataFrame.unionByName, kept).select("table_name", "kept")


@query(
    "cleanup_source",
    """SELECT count(*) FILTER (WHERE event_timestamp < TIMESTAMP '2024-01-15 12:00:00') AS would_delete,
       count(*) FILTER (WHERE event_timestamp IS NULL OR event_timestamp >= TIMESTAMP '2024-01-15 12:00:00') AS kept FROM logs""",
)
def _(c):
    path = scratch_path(c.spark, "cleaned")
    c.logs.select("log_id", "event_timestamp", F.date_trunc("week", "event_timestamp").cast("date").alias("log_week")).write.partitionBy("log_week").parquet(path)
    planned = io.cleanup(c.spark, path, "2024-01-15 12:00:00", "log_week", dry_run=True).agg(F.sum("deleted").alias("would_delete"))
    io.cleanup(c.spark, path, "2024-01-15 12:00:00", "log_week")
    return c.spark.read.parquet(path).agg(F.count("*").alias("kept")).join(F.broadcast(planned))


@query(
    "route_by_severity",
    f"""SELECT 'analytics' AS route, count(*) AS n FROM logs WHERE {level_sql('severity')} >= 200 UNION ALL SELECT 'archive', count(*) FROM logs WHERE {level_sql('severity')} >= 200
        UNION ALL SELECT 'alerts', count(*) FROM logs WHERE {level_sql('severity')} >= 500""",
)
def _(c):
    rows = c.logs.withColumn("severity_level", severity_level("severity"))
    parts = [df.agg(F.lit(name).alias("route"), F.count("*").alias("n")).select("route", "n") for name, df in io.routes(rows).items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "union_sharded",
    """SELECT insert_id AS "insertId", ts AS timestamp, text_payload AS "textPayload" FROM raw_flat WHERE sink_kind = 'signup'
       UNION ALL SELECT NULL, ts, text_payload FROM raw_flat WHERE sink_kind = 'view'""",
)
def _(c):
    parts = [raw_sink(c, "build").select("insertId", "timestamp", "textPayload"), raw_sink(c, "varlog").select("timestamp", "textPayload")]
    return io.union_sharded(parts).select("insertId", "timestamp", "textPayload")
