"""Named queries: filters, listings, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions.timewin import EVENTS_AS_OF as AS_OF
from lumenlog.operators import listing as q
from lumenlog.operators import normalize as n
from lumenlog.plans.oracle_views import level_sql, log_type_sql, present
from lumenlog.plans.registry import query
from lumenlog.plans.shapes import typed_logs, unified

WEEK = "log_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-31' AND event_timestamp >= TIMESTAMP '2024-01-24 00:00:00'"
LISTED = f"""log_id, event_timestamp, severity, service_name, source_table AS source_log_name, message, source_table, stream_id, trace_id, span_id,
    {log_type_sql('source_table')} AS log_type, resource_type"""


def newest(select: str, source: str, where: str, limit: int) -> str:
    return f"SELECT {select} FROM {source} WHERE {where} ORDER BY event_timestamp DESC, log_id LIMIT {limit}"


@query("list_logs", newest(LISTED, "logs", WEEK, 100))
def _(c):
    return q.list_logs(typed_logs(c), q.ListParams(limit=100, hours=168), AS_OF)


@query(
    "list_logs_filtered",
    newest(LISTED, "logs", f"{WEEK} AND severity = 'ERROR' AND contains(service_name, 'svc-1') AND (contains(message, 'failed') OR coalesce(contains(json_payload, 'failed'), false)) AND source_table = 'run_googleapis_com_stderr'", 250),
)
def _(c):
    params = q.ListParams(limit=250, hours=168, severity="error", service="svc-1", search="failed", source_table="run_googleapis_com_stderr")
    return q.list_logs(typed_logs(c), params, AS_OF)


@query(
    "list_logs_envelope",
    newest(
        f"""log_id, event_timestamp, severity, service_name, source_log_name, message, source_table, stream_id, trace_id, span_id, log_type, resource_type,
        log_id AS envelope_event_id, event_timestamp AS envelope_event_ts, service_name AS envelope_service_name, trace_id AS envelope_trace_id,
        principal_email AS envelope_user_id, privacy_pii_risk AS envelope_pii_risk, environment AS envelope_environment,
        coalesce(correlation_request_id, operation_id) AS envelope_request_id, correlation_session_id AS envelope_session_id""",
        "o_normal",
        WEEK + " AND (contains(message, 'sessions') OR coalesce(contains(json_payload, 'sessions'), false))",
        100,
    ),
)
def _(c):
    return q.list_logs_envelope(unified(c), q.ListParams(limit=100, hours=168, search="sessions"), AS_OF)


@query(
    "canonical_range",
    """SELECT * FROM logs WHERE event_timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 12:00:00' AND severity = 'ERROR'
       ORDER BY event_timestamp DESC, log_id LIMIT 50 OFFSET 100""",
)
def _(c):
    return q.canonical_range(c.logs, "2024-01-05 00:00:00", "2024-01-25 12:00:00", severity="ERROR", limit=50, offset=100)


@query(
    "search_logs",
    newest("*", "logs", f"{WEEK} AND event_timestamp <= TIMESTAMP '2024-01-31 00:00:00' AND (contains(lower(message), 'connection') OR coalesce(contains(lower(json_payload), 'connection'), false))", 20),
)
def _(c):
    return q.search_logs(c.logs, "Connection", AS_OF, hours=168)


MONTH = "log_date BETWEEN DATE '2023-12-31' AND DATE '2024-01-31' AND event_timestamp BETWEEN TIMESTAMP '2023-12-31 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"


@query(
    "top_errors",
    f"""SELECT event_timestamp AS timestamp, severity, {present('service_name', "'unknown'")} AS service, substr(coalesce(message, ''), 1, 300) AS message,
        trace_id, source_table AS source, resource_type, log_id FROM logs WHERE {MONTH} AND severity IN ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY')
        ORDER BY event_timestamp DESC, log_id LIMIT 25""",
)
def _(c):
    return q.top_errors(c.logs, AS_OF, 744)


@query(
    "top_warnings",
    f"""SELECT event_timestamp AS timestamp, {present('service_name', "'unknown'")} AS service, substr(coalesce(message, ''), 1, 200) AS message, log_id
        FROM logs WHERE {MONTH} AND severity = 'WARNING' ORDER BY event_timestamp DESC, log_id LIMIT 15""",
)
def _(c):
    return q.top_warnings(c.logs, AS_OF, 744)


@query(
    "recent_matching",
    newest(
        "log_id, event_timestamp, severity, service_name, trace_id, span_id, message, source_table",
        "logs",
        "log_date >= DATE '2024-01-24' AND contains(lower(message), 'connection failed') AND severity IN ('ERROR', 'CRITICAL', 'WARNING')",
        5,
    ),
)
def _(c):
    return q.recent_matching(c.logs, "Connection failed", AS_OF)




@query("logs_by_trace", "SELECT * FROM logs WHERE trace_id = (SELECT max(trace_id) FROM logs) ORDER BY event_timestamp, log_id LIMIT 100")
def _(c):
    newest_trace = c.logs.agg(F.max("trace_id").alias("trace_id")).first()["trace_id"]
    return q.logs_by_trace(c.logs, newest_trace)


@query("log_by_id", "SELECT * FROM logs WHERE log_id = '77' ORDER BY event_timestamp LIMIT 1")
def _(c):
    return q.log_by_id(c.logs, "77")


@query("log_by_insert_id", "SELECT * FROM logs WHERE insert_id = 'ins-100' ORDER BY event_timestamp, log_id LIMIT 1")
def _(c):
    return q.log_by_insert_id(c.logs, "ins-100")


@query("failed_requests", "SELECT * FROM requests WHERE service_name = 'svc-1' AND contains(request_url, '/api/sessions') AND status >= 500")
def _(c):
    return q.failed_requests(c.requests, "svc-1", "/api/sessions")


@query(
    "trace_explorer",
    "SELECT log_id, trace_id, span_id, event_timestamp, message FROM logs WHERE trace_id IS NOT NULL AND severity = 'ERROR' ORDER BY event_timestamp DESC NULLS LAST, log_id LIMIT 50",
)
def _(c):
    return q.trace_explorer(c.logs)


@query(
    "errors_projection",
    f"SELECT log_id, event_timestamp, log_date, severity, {level_sql('severity')} AS severity_level, service_name, message FROM logs WHERE {level_sql('severity')} >= 500 AND log_date IS NOT NULL",
)
def _(c):
    rows = c.logs.select("log_id", "event_timestamp", "log_date", "severity", n.severity_level("severity").alias("severity_level"), "service_name", "message")
    return q.errors_projection(rows.withColumns({"source_system": F.lit("logs"), "source_view": F.lit("logs")}))


FACT = [x for x in q.FACT_COLUMNS if x not in ("universal_envelope", "error_group_id", "etl_batch_id", "etl_status")]


@query(
    "fact_logs",
    f"SELECT {', '.join(FACT)}, coalesce(correlation_request_id, operation_id, trace_id) AS correlation_id, 'logs' AS source_system, 'envelope_logs' AS source_view FROM o_normal WHERE log_date IS NOT NULL",
)
def _(c):
    return q.fact_logs(unified(c)).drop("universal_envelope")


@query(
    "tail",
    "SELECT * FROM logs WHERE event_timestamp > TIMESTAMP '2024-01-20 00:00:00' OR (event_timestamp = TIMESTAMP '2024-01-20 00:00:00' AND log_id > '5') ORDER BY event_timestamp, log_id LIMIT 10",
)
def _(c):
    return q.tail(c.logs, "2024-01-20 00:00:00", "5")


@query(
    "list_by_status",
    "SELECT job_id, stream_id, started_at, status FROM etl_jobs WHERE stream_id = 'logs_v1.error' AND status = 'COMPLETED' ORDER BY started_at DESC, job_id LIMIT 20",
)
def _(c):
    return q.list_by_status(c.etl_jobs, "logs_v1.error", "stream_id", "COMPLETED", "started_at", "job_id").select("job_id", "stream_id", "started_at", "status")


@query("distinct_services", "SELECT DISTINCT service_name FROM logs")
def _(c):
    return q.distinct_services(c.logs)


@query(
    "unacknowledged_alerts",
    "SELECT job_id, started_at, status FROM etl_jobs WHERE status = 'FAILED' AND NOT priority ORDER BY started_at DESC, job_id LIMIT 20",
)
def _(c):
    return q.unacknowledged_alerts(c.etl_jobs.withColumnRenamed("priority", "acknowledged")).select("job_id", "started_at", "status")


@query("running_jobs", "SELECT * FROM etl_jobs WHERE status = 'RUNNING'")
def _(c):
    return q.running_jobs(c.etl_jobs)


@query("recent_jobs", "SELECT * FROM etl_jobs ORDER BY started_at DESC, job_id LIMIT 20")
def _(c):
    return q.recent_jobs(c.etl_jobs)


@query("create_view", "SELECT service_name, count(*) AS n FROM logs WHERE severity = 'ERROR' GROUP BY service_name")
def _(c):
    q.save_view(c.logs.filter(F.col("severity") == "ERROR"), "lumenlog_error_rows")
    return c.spark.table("lumenlog_error_rows").groupBy("service_name").agg(F.count("*").alias("n"))


@query("run_sql", "SELECT severity, count(*) AS n FROM logs WHERE log_date >= DATE '2024-01-10' AND source_table = 'cloudbuild' GROUP BY severity")
def _(c):
    text = "SELECT severity, count(*) AS n FROM lumenlog_logs WHERE log_date >= CAST(:day AS DATE) AND source_table = :source GROUP BY severity"
    return q.run_sql(c.spark, text, {"day": "2024-01-10", "source": "cloudbuild"}, lumenlog_logs=c.logs)


@query(
    "preview",
    "SELECT log_id, event_timestamp, severity, substr(message, 1, 200) AS message, substr(json_payload, 1, 200) AS json_payload FROM logs ORDER BY event_timestamp DESC NULLS LAST, log_id LIMIT 5",
)
def _(c):
    return q.preview(c.logs.select("log_id", "event_timestamp", "severity", "message", "json_payload"))


@query(
    "backfill",
    f"""SELECT log_id, stream_id, coalesce(nullif(service_name, ''), 'unknown-service') AS service, coalesce(severity, 'DEFAULT') AS severity, event_timestamp AS timestamp,
        {present('text_payload', 'json_payload', 'proto_payload')} AS content FROM records
        JOIN (SELECT log_id AS lid, service_name FROM o_payload) AS p ON lid = log_id
        WHERE event_timestamp > TIMESTAMP '2024-01-01 00:00:00' AND {present('text_payload', 'json_payload', 'proto_payload')} IS NOT NULL
        ORDER BY event_timestamp, log_id LIMIT 1000""",
)
def _(c):
    from lumenlog.sources.io import backfill

    rows = n.payload_columns(n.parse_record(c.records)).select("log_id", "service_name")
    return backfill(c.records.join(rows, "log_id"), AS_OF, hours=720, limit=1000)


