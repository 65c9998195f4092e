"""Named queries: tracing, correlation and alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.adapters import ORACLE_VIEWS
from lumenlog.functions.columns import first_present
from lumenlog.functions.timewin import EVENTS_AS_OF as AS_OF
from lumenlog.operators import dimensions, listing
from lumenlog.operators import tracing as t
from lumenlog.plans.registry import query, r, rounded

NULL = "CAST(NULL AS VARCHAR)"
ORACLE_VIEWS["policies"] = """
SELECT CAST(fetched_at AS DATE) AS policy_snapshot_date, json_extract_string(payload, '$.project') AS project_id, json_extract_string(payload, '$.name') AS resource,
       json_extract_string(unnest(json_extract(b, '$.members[*]')), '$') AS member, json_extract_string(b, '$.role') AS role, json_extract_string(b, '$.condition') AS condition
FROM (SELECT fetched_at, payload, unnest(json_extract(payload, '$.iamPolicy.bindings[*]')) AS b FROM assets) AS x
"""
ORACLE_VIEWS["traces"] = f"""
SELECT trace_id, span_id, coalesce(json_extract_string(labels, '$.request_id'), trace_id) AS correlation_id, event_timestamp AS event_ts, severity, service_name, {NULL} AS project_id,
       {NULL} AS resource_type, 'u-' || user_id AS user_id, CAST(NULL AS DOUBLE) AS cost_usd, is_error, 'logs' AS source_system, {NULL} AS source_dataset, {NULL} AS source_table,
       {NULL} AS etl_job_id, {NULL} AS etl_version FROM logs_rich
UNION ALL SELECT sha256(project_id || '-' || CAST(dt AS VARCHAR) || '-' || job_id), NULL, job_id, CAST(dt AS TIMESTAMP), 'INFO', 'bigquery', project_id, 'bigquery_job', user_name,
       total_bytes_processed * 1e-9, false, 'finops', 'finops', 'jobs_daily', job_id, 'v2' FROM jobs
UNION ALL SELECT coalesce(trace_id, invocation_id), NULL, session_id, started_at, 'INFO', tool_name, NULL, 'agent_tool', user_id, NULL, status IN ('error', 'failure'), 'agent', 'agent',
       'tool_invocations', invocation_id, '1.0.0' FROM tool_inv
UNION ALL SELECT NULL, NULL, project_id || ':' || resource, CAST(policy_snapshot_date AS TIMESTAMP), 'INFO', 'policy', project_id, 'policy_binding', member, NULL, false, 'org_model',
       'enterprise', 'fact_policy', NULL, 'v1' FROM policies WHERE member IS NOT NULL AND project_id IS NOT NULL
"""


def traces(c):
    facts = c.logs_rich.withColumns(
        {
            "correlation_id": F.coalesce(F.get_json_object("labels", "$.request_id"), "trace_id"),
            "user_id": F.concat(F.lit("u-"), "user_id"),
            "resource_type": F.lit(None),
            "source_dataset": F.lit(None),
            "source_table": F.lit(None),
            "etl_version": F.lit(None),
        }
    )
    return t.traces_unified(facts, c.jobs, c.tool_inv, dimensions.fact_policy(c.assets))


@query("traces_unified", f"SELECT * REPLACE ({r('cost_usd')} AS cost_usd) FROM traces")
def _(c):
    return rounded(traces(c), "cost_usd")


@query(
    "cross_system_traces",
    """SELECT trace_id, count(DISTINCT source_system) AS systems_in_trace, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS systems_list FROM traces
       WHERE trace_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_system) > 1""",
)
def _(c):
    return t.cross_system_traces(traces(c))


@query(
    "system_summary",
    f"""SELECT source_system, count(*) AS total_events, count(DISTINCT trace_id) AS unique_traces, count(DISTINCT correlation_id) AS unique_correlations, count(DISTINCT user_id) AS unique_users,
        {r('avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END)', 6)} AS error_rate, min(event_ts) AS earliest_event, max(event_ts) AS latest_event FROM traces GROUP BY 1""",
)
def _(c):
    return rounded(t.system_summary(traces(c)), "error_rate", digits=6)


ANCHORS = """a AS (SELECT log_id AS anchor_id, service_name AS anchor_service, trace_id AS anchor_trace, event_timestamp AS anchor_ts FROM logs WHERE log_date >= DATE '2024-01-24'
    AND contains(lower(message), 'connection') AND severity IN ('ERROR', 'CRITICAL', 'WARNING') ORDER BY event_timestamp DESC, log_id LIMIT 5)"""


@query(
    "related_logs",
    """WITH a AS (SELECT log_id AS anchor_id, service_name AS anchor_service, event_timestamp AS anchor_ts FROM logs WHERE severity IN ('ERROR', 'CRITICAL', 'WARNING')),
        j AS (SELECT anchor_id, log_id, event_timestamp, severity, service_name, substr(coalesce(message, ''), 1, 200) AS message, trace_id, event_timestamp = anchor_ts AS is_error,
        CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY event_timestamp, log_id) AS INTEGER) AS rn FROM logs JOIN a ON service_name = anchor_service
        AND event_timestamp BETWEEN anchor_ts - INTERVAL 30 MINUTE AND anchor_ts + INTERVAL 30 MINUTE) SELECT * FROM j WHERE rn <= 50""",
)
def _(c):
    return t.related_logs(c.logs.filter("severity IN ('ERROR', 'CRITICAL', 'WARNING')"), c.logs)


@query(
    "trace_context",
    f"""WITH {ANCHORS}, j AS (SELECT anchor_id, log_id, event_timestamp, severity, service_name, span_id, substr(coalesce(message, ''), 1, 200) AS message,
        CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY event_timestamp NULLS FIRST, log_id) AS INTEGER) AS rn FROM logs JOIN a ON trace_id = anchor_trace) SELECT * FROM j WHERE rn <= 30""",
)
def _(c):
    return t.trace_context(listing.recent_matching(c.logs, "connection", AS_OF), c.logs)


SPANS = "(SELECT trace_id, span_id, parent_span_id, service_name, CASE WHEN is_error THEN 'ERROR' ELSE 'OK' END AS status, coalesce(http_latency_ms, 1.0) AS duration_ms FROM logs_rich) AS s"


@query(
    "span_latency",
    f"""SELECT s.*, coalesce(k.child_count, 0) AS child_count, s.duration_ms - coalesce(k.children_ms, 0) AS self_ms FROM {SPANS}
        LEFT JOIN (SELECT trace_id, parent_span_id, sum(duration_ms) AS children_ms, count(*) AS child_count FROM {SPANS} WHERE parent_span_id IS NOT NULL GROUP BY ALL) AS k
        ON k.trace_id = s.trace_id AND k.parent_span_id = s.span_id""",
)
def _(c):
    spans = c.logs_rich.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "service_name",
        F.when(F.col("is_error"), "ERROR").otherwise("OK").alias("status"),
        F.coalesce("http_latency_ms", F.lit(1.0)).alias("duration_ms"),
    )
    return t.span_latency(spans)


MONTH = "event_timestamp > TIMESTAMP '2024-01-01 00:00:00'"


@query(
    "alert_rules",
    f"""SELECT '5xx Rate Alert' AS rule, 'critical' AS severity, value, CAST(10 AS DOUBLE) AS threshold, coalesce(value > 10, false) AS fired FROM (SELECT CAST(count(*) FILTER (WHERE status >= 500) AS DOUBLE) AS value FROM requests WHERE {MONTH})
        UNION ALL SELECT 'Latency P95 Alert', 'warning', value, 5, coalesce(value > 5, false) FROM (SELECT quantile_disc(latency_s, 0.95) AS value FROM requests WHERE {MONTH})
        UNION ALL SELECT 'Error Cluster Growth', 'warning', value, 1, coalesce(value >= 1, false) FROM (SELECT CAST(count(*) FILTER (WHERE n > 5) AS DOUBLE) AS value FROM
            (SELECT coalesce(service_name, 'unknown') || coalesce(message, '') AS f, count(*) AS n FROM logs WHERE severity = 'ERROR' AND {MONTH} GROUP BY 1))
        UNION ALL SELECT 'Audit Anomalies', 'info', value, 5, coalesce(value > 5, false) FROM (SELECT CAST(count(*) FILTER (WHERE status = 'PERMISSION_DENIED') AS DOUBLE) AS value FROM audit WHERE {MONTH})""",
)
def _(c):
    key = F.md5(F.concat(first_present("service_name", F.lit("unknown")), F.coalesce("message", F.lit(""))))
    month = 30 * 24 * 60
    return t.alert_rules(c.requests, c.logs.withColumn("error_fingerprint", key), c.audit, AS_OF, minutes=(month, month, month, month))
