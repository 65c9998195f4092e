"""Named queries: raw sinks onto the canonical contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.adapters import ORACLE_VIEWS
from lumenlog.contracts import CANONICAL_COLUMNS
from lumenlog.functions import ids
from lumenlog.functions.timewin import EVENTS_AS_OF as AS_OF
from lumenlog.operators import listing
from lumenlog.operators import mappings as m
from lumenlog.plans.registry import query
from lumenlog.plans.shapes import SINK_KINDS, canonical, raw_sink, raw_sinks

PREFIX = "'projects/p1/traces/'"
MINUTE = "(CAST(date_trunc('minute', ts) AS VARCHAR) || '+00')"
TS = "(CAST(ts AS VARCHAR) || '+00')"


def b(column: str) -> str:
    return f"coalesce({column}, '')"


def obj(**fields: str) -> str:
    inner = ", ".join(f"'{k}': {v}" for k, v in fields.items())
    return f"CAST(to_json({{{inner}}}) AS VARCHAR)"


def trace(*key: str) -> str:
    return f"coalesce(trace, {PREFIX} || md5({' || '.join(key)}))"


def span(*key: str) -> str:
    return f"coalesce(span_id, substr(md5({' || '.join(key)}), 1, 16))"


NULL = "CAST(NULL AS VARCHAR)"
SINK_TABLES = {
    "activity": "cloudaudit_googleapis_com_activity", "data_access": "cloudaudit_googleapis_com_data_access",
    "system_event": "cloudaudit_googleapis_com_system_event", "stdout": "run_googleapis_com_stdout", "stderr": "run_googleapis_com_stderr",
    "requests": "run_googleapis_com_requests", "varlog": "run_googleapis_com_varlog_system", "syslog": "syslog", "build": "cloudbuild",
    "insights": "clouderrorreporting_googleapis_com_insights", "scheduler": "cloudscheduler_googleapis_com_executions",
}


def mapped_sql(name: str, null_safe: bool = False) -> str:
    svc_key = "coalesce(svc, 'run')" if null_safe else "svc"
    message = obj(message="json_message")

    def container(severity: str, log: str) -> dict[str, str]:
        return {
            "insert_id": f"md5({TS} || {b('trace')} || {b('span_id')} || {b('text_payload')} || {b('svc')})", "severity": f"coalesce(severity, '{severity}')",
            "log_name": f"'{log}'", "service_name": "svc", "resource_type": "'cloud_run_revision'" if null_safe else "coalesce(resource_type, 'cloud_run_revision')",
            "resource_labels": obj(service_name="svc", project_id="project_id"), "trace_id": trace(svc_key, "'-'", MINUTE),
            "span_id": span(TS, b("text_payload")), "text_payload": "text_payload", "json_payload": message, "display_message": "text_payload",
        }

    def audit(default: str) -> dict[str, str]:
        service, payload = f"coalesce(audit_service, '{default}')", obj(serviceName="audit_service", methodName="method_name")
        return {
            "insert_id": "insert_id", "log_name": "log_name", "service_name": service, "resource_type": "coalesce(resource_type, 'audited_resource')",
            "resource_labels": obj(project_id="project_id"), "trace_id": trace(service, "'-'", MINUTE), "span_id": span("insert_id"),
            "json_payload": payload, "proto_payload": payload, "display_message": "coalesce(method_name, '')",
        }

    proto = "CAST(to_json({'methodName': method_name, 'response': {'message': json_message}}) AS VARCHAR)"
    job = "job_id"
    started, finished = "phase < 2", "phase IN (2, 3)"
    sched_job = f"CASE WHEN {started} OR {finished} THEN {job} END"
    fields = {
        "activity": {
            "insert_id": "insert_id", "log_name": "log_name", "service_name": "coalesce(svc, build_id, 'audit')", "resource_type": "coalesce(resource_type, 'audited_resource')",
            "resource_labels": obj(service_name="svc", module_id="build_id", project_id="project_id"), "trace_id": trace("coalesce(svc, 'audit')", "'-'", MINUTE),
            "span_id": span("insert_id"), "json_payload": proto, "proto_payload": proto, "display_message": "coalesce(json_message, log_name)",
        },
        "data_access": audit("bigquery"),
        "system_event": audit("system"),
        "stdout": container("INFO", "run.googleapis.com/stdout"),
        "stderr": container("ERROR", "run.googleapis.com/stderr"),
        "requests": {
            "insert_id": f"coalesce(insert_id, md5({TS} || {b('trace')} || {b('http_url')}))", "receive_timestamp": "receive_ts",
            "log_name": "coalesce(log_name, 'run.googleapis.com/requests')", "service_name": "svc", "resource_type": "coalesce(resource_type, 'cloud_run_revision')",
            "resource_labels": obj(service_name="svc"), "trace_id": trace(svc_key, "'-'", MINUTE), "span_id": span(TS, b("http_url")), "trace_sampled": "trace_sampled",
            "json_payload": obj(requestMethod="http_method", requestUrl="http_url"), "display_message": "coalesce(http_method, 'GET') || ' ' || coalesce(http_url, '/')",
        },
        "varlog": {
            "insert_id": f"md5({TS} || {b('trace')} || {b('text_payload')} || {b('svc')})", "log_name": "'run.googleapis.com/varlog/system'", "service_name": "svc",
            "resource_type": "coalesce(resource_type, 'cloud_run_revision')", "resource_labels": obj(service_name="svc"), "trace_id": trace(svc_key, "'-'", MINUTE),
            "span_id": span(TS, b("text_payload")), "text_payload": "text_payload", "json_payload": "'{}'", "display_message": "text_payload",
        },
        "syslog": {
            "insert_id": f"md5({TS} || {b('trace')} || {b('span_id')} || {b('text_payload')})", "log_name": "'syslog'", "service_name": "'compute'", "resource_type": "'global'",
            "resource_labels": "'{}'", "trace_id": trace("'compute'", "'-'", MINUTE), "span_id": span(TS, b("text_payload")), "text_payload": "text_payload",
            "json_payload": message, "display_message": "text_payload",
        },
        "build": {
            "insert_id": f"coalesce(insert_id, md5({TS} || {b('text_payload')} || {b('build_id')}))", "receive_timestamp": "receive_ts", "log_name": "coalesce(log_name, 'cloudbuild')",
            "service_name": "'cloudbuild'", "resource_type": "coalesce(resource_type, 'build')", "resource_labels": obj(build_id="build_id"),
            "trace_id": trace("'cloudbuild'", "'-'", MINUTE, "'-'", b("build_id")), "span_id": span(TS, b("build_id")), "trace_sampled": "trace_sampled",
            "text_payload": "text_payload", "json_payload": f"'{{\"build_id\":\"' || {b('build_id')} || '\"}}'", "display_message": "text_payload",
        },
        "insights": {
            "insert_id": "insert_id", "receive_timestamp": "receive_ts", "severity": "coalesce(severity, 'ERROR')", "log_name": "log_name",
            "service_name": "coalesce(project_id, 'error-reporting')", "resource_type": "coalesce(resource_type, 'global')", "resource_labels": obj(project_id="project_id"),
            "trace_id": trace(b("insert_id"), "'-'", MINUTE), "span_id": span(f"coalesce(insert_id, {TS})"), "trace_sampled": "trace_sampled", "text_payload": "text_payload",
            "json_payload": "CAST(to_json({'message': json_message, 'exceptioninfo': {'message': method_name}, 'errorevent': {'message': audit_service}}) AS VARCHAR)",
            "display_message": "coalesce(json_message, method_name, audit_service, text_payload, 'Error Reporting Insight')",
        },
        "scheduler": {
            "insert_id": "insert_id", "receive_timestamp": "receive_ts", "log_name": "log_name", "service_name": f"coalesce(build_id, {sched_job}, 'cloud-scheduler')",
            "resource_type": "coalesce(resource_type, 'cloud_scheduler_job')", "resource_labels": obj(job_id="build_id"), "trace_id": trace(b("insert_id"), "'-'", MINUTE),
            "span_id": span(f"coalesce(insert_id, {TS})"), "trace_sampled": "trace_sampled", "text_payload": "text_payload",
            "json_payload": f"CASE WHEN {started} THEN {obj(jobname=job)} WHEN {finished} THEN {obj(jobname=job, status='project_id')} ELSE {chr(39) + '{}' + chr(39) if null_safe else 'NULL'} END",
            "display_message": f"'Job: ' || coalesce({sched_job}, 'unknown') || ' - ' || CASE WHEN {started} THEN 'Started' WHEN {finished} THEN 'Finished: ' || coalesce(project_id, 'unknown') ELSE 'Unknown' END",
        },
    }[name]
    shared = {
        "severity": "coalesce(severity, 'INFO')", "event_timestamp": "ts", "receive_timestamp": "CAST(NULL AS TIMESTAMP)", "trace_sampled": "CAST(NULL AS BOOLEAN)",
        "source_dataset": "'logs'", "source_table": f"'{SINK_TABLES[name]}'", "ingestion_method": "'sink'",
    }
    values = shared | fields
    columns = m.REDUCED_COLUMNS if null_safe else CANONICAL_COLUMNS
    picked = ", ".join(f"{values.get(k, NULL)} AS {k}" for k in columns)
    return f"SELECT {picked} FROM raw_flat WHERE sink_kind = '{SINK_KINDS[name]}'"


ORACLE_VIEWS["canonical"] = "\nUNION ALL\n".join(mapped_sql(name) for name in SINK_KINDS)


def _register(name: str) -> None:
    @query(f"map_{name}", mapped_sql(name))
    def _(c):
        return m.MAPPINGS[name](raw_sink(c, name))


for _name in SINK_KINDS:
    _register(_name)


@query("map_insights_with_time", mapped_sql("insights") + " AND ts IS NOT NULL")
def _(c):
    return m.with_time(m.error_insights(raw_sink(c, "insights")))


@query("canonical", "SELECT * FROM canonical")
def _(c):
    return canonical(c)


@query("canonical_reduced", "\nUNION ALL\n".join(mapped_sql(name, null_safe=True) for name in SINK_KINDS))
def _(c):
    return m.canonical_reduced(raw_sinks(c))


V1 = {
    "activity": ("'cloudaudit_activity'", "resource_type", "project_id", "coalesce(svc, build_id, '')", "method_name", "''",
                 "CAST(to_json({'methodName': method_name, 'response': {'message': json_message}}) AS VARCHAR)"),
    "stdout": ("'run_stdout'", "resource_type", "project_id", "svc", "''", "text_payload", obj(message="json_message")),
    "stderr": ("'run_stderr'", "resource_type", "project_id", "svc", "''", "text_payload", obj(message="json_message")),
    "syslog": ("'syslog'", NULL, NULL, "''", "''", "text_payload", obj(message="json_message")),
}


def _v1(name: str) -> str:
    table, rtype, project, service, operation, message, payload = V1[name]
    return f"""SELECT ts AS event_ts, receive_ts, {table} AS source_table, {rtype} AS resource_type, {project} AS project_id, {service} AS service, severity, trace,
        span_id AS "spanId", {operation} AS operation, {payload} AS json_payload_str, {NULL} AS labels_json,
        coalesce(nullif({message}, ''), json_extract_string({payload}, '$.message'), json_extract_string({payload}, '$.msg'), 'No message content') AS display_message
        FROM raw_flat WHERE sink_kind = '{SINK_KINDS[name]}'"""


@query("canonical_v1", "\nUNION ALL\n".join(_v1(n) for n in V1))
def _(c):
    return m.canonical_v1(raw_sinks(c))


@query("synthetic_insert_id", f"SELECT event_id, md5({TS} || {b('trace')} || {b('span_id')} || {b('text_payload')} || {b('svc')}) AS insert_id FROM raw_flat")
def _(c):
    key = ids.synthetic_insert_id(ids.ts_text("ts"), ids.blank("trace"), ids.blank("span_id"), ids.blank("text_payload"), ids.blank("svc"))
    return c.raw_flat.select("event_id", key.alias("insert_id"))


@query(
    "synthetic_trace_id",
    f"SELECT log_id, coalesce(trace_id, {PREFIX} || md5(service_name || '-' || CAST(date_trunc('minute', event_timestamp) AS VARCHAR) || '+00')) AS trace_id FROM logs",
)
def _(c):
    return c.logs.select("log_id", ids.synthetic_trace_id("trace_id", F.col("service_name"), ids.minute_text("event_timestamp")).alias("trace_id"))


@query("synthetic_span_id", "SELECT log_id, coalesce(span_id, substr(md5(insert_id), 1, 16)) AS span_id FROM logs")
def _(c):
    return c.logs.select("log_id", ids.synthetic_span_id("span_id", F.col("insert_id")).alias("span_id"))


@query(
    "catalog_upsert",
    """WITH t AS (SELECT 'logs_v1' AS source_dataset, source_table, max(CAST(log_date AS VARCHAR)) AS notes, count(*) AS row_count FROM logs WHERE log_date < DATE '2024-01-15' GROUP BY source_table
                  UNION ALL SELECT 'logs_v0', stream_id, 'old', count(*) FROM logs GROUP BY stream_id),
       s AS (SELECT 'logs_v1' AS source_dataset, source_table, max(CAST(log_date AS VARCHAR)) AS notes, count(*) AS row_count FROM logs GROUP BY source_table)
       SELECT * FROM s UNION ALL SELECT * FROM t WHERE (source_dataset, source_table) NOT IN (SELECT (source_dataset, source_table) FROM s)""",
)
def _(c):
    def catalog(df):
        return df.groupBy("source_table").agg(F.max(F.col("log_date").cast("string")).alias("notes"), F.count("*").alias("row_count")).select(
            F.lit("logs_v1").alias("source_dataset"), "source_table", "notes", "row_count"
        )

    legacy = c.logs.groupBy(F.col("stream_id").alias("source_table")).agg(F.count("*").alias("row_count"))
    legacy = legacy.select(F.lit("logs_v0").alias("source_dataset"), "source_table", F.lit("old").alias("notes"), "row_count")
    return m.catalog_upsert(catalog(c.logs.filter(F.col("log_date") < "2024-01-15")).unionByName(legacy), catalog(c.logs))


def _described(table: str) -> str:
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}
    kind = "CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in kinds.items()) + " END"
    return f"""SELECT '{table}' AS table_name, column_name, {kind} AS data_type, 'NULLABLE' AS mode, column_name = 'log_date' AS is_partition, column_name IN ('severity', 'service_name') AS is_cluster,
        (SELECT count(*) FROM {table}) AS row_count FROM (DESCRIBE SELECT * FROM {table}) AS d"""


INVENTORIED = ("events", "documents", "customer", "labels")


@query("schema_inventory", " UNION ALL ".join(_described(t) for t in INVENTORIED))
def _(c):
    return m.schema_inventory({t: getattr(c, t) for t in INVENTORIED}, partition_by="log_date", cluster_by=("severity", "service_name"), counts=True)


@query(
    "schema_changelog",
    """SELECT 'v2' AS change_version, change_type, 'table' AS object_type, 'logs.' || col AS object_name, TIMESTAMP '2024-01-31 00:00:00' AS applied_at, 'build' AS applied_by, description, row_count
       FROM (VALUES ('add', 'span_id', 'string'), ('alter', 'severity', 'string -> int')) AS v(change_type, col, description), (SELECT count(*) AS row_count FROM logs)""",
)
def _(c):
    before = m.schema_inventory({"logs": c.logs.drop("span_id")})
    after = m.schema_inventory({"logs": c.logs.withColumn("severity", n_level())}, counts=True)
    changes = m.schema_changelog(m.schema_diff(before, after), "v2", AS_OF, "build")
    rows = after.select(F.concat_ws(".", "table_name", "column_name").alias("object_name"), "row_count")
    return changes.join(rows, "object_name", "left")


def n_level():
    from lumenlog.operators.normalize import severity_level

    return severity_level("severity")


@query(
    "list_canonical",
    """SELECT event_timestamp, severity, service_name, log_name, display_message, source_table, insert_id, trace_id, span_id FROM canonical
       WHERE event_timestamp >= TIMESTAMP '2024-01-24 00:00:00' AND (coalesce(contains(display_message, 'msg'), false) OR coalesce(contains(json_payload, 'msg'), false))
       ORDER BY event_timestamp DESC, insert_id NULLS FIRST, source_table, span_id LIMIT 100""",
)
def _(c):
    return listing.list_canonical(canonical(c), listing.ListParams(limit=100, hours=168, search="msg"), AS_OF)
