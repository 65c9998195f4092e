"""Named queries: counts, rates and rankings over log rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions.timewin import EVENTS_AS_OF as AS_OF
from lumenlog.operators import aggregates as a
from lumenlog.operators import normalize as n
from lumenlog.operators import summaries
from lumenlog.plans.oracle_views import log_type_sql, present
from lumenlog.plans.registry import query, r, rounded
from lumenlog.plans.shapes import unified
from lumenlog.session import scratch_path

ALL = 24 * 31  # hours: the whole data set
SINCE = "log_date BETWEEN DATE '2023-12-31' AND DATE '2024-01-31' AND event_timestamp >= TIMESTAMP '2023-12-31 00:00:00'"
RANGE = SINCE + " AND event_timestamp <= TIMESTAMP '2024-01-31 00:00:00'"
ERR4 = "severity IN ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY')"
ERR2 = "severity IN ('ERROR', 'CRITICAL')"
SERVICE = present("service_name", "'unknown'")


def n_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


@query("count_by_severity", f"SELECT severity, count(*) AS count FROM logs WHERE {SINCE} GROUP BY severity")
def _(c):
    return a.count_by_severity(c.logs, AS_OF, ALL)


@query("count_by_service", f"SELECT service_name, count(*) AS count, {n_if(ERR4)} AS error_count FROM logs WHERE {SINCE} GROUP BY service_name")
def _(c):
    return a.count_by_service(c.logs, AS_OF, ALL)


@query("source_table_stats", f"SELECT source_table, stream_id, count(*) AS count FROM logs WHERE {SINCE} GROUP BY ALL")
def _(c):
    return a.source_table_stats(c.logs, AS_OF, ALL)


@query("count_by_resource_type", "SELECT resource_type, count(*) AS count FROM logs GROUP BY ALL")
def _(c):
    return a.count_by(c.logs, "resource_type")


@query("count_by_service_severity", f"SELECT service_name, severity, count(*) AS count FROM logs WHERE {SINCE} GROUP BY ALL")
def _(c):
    return a.count_by_service_severity(c.logs, AS_OF, ALL)


@query("severity_totals", f"SELECT count(*) AS total_logs, {n_if(ERR2)} AS error_count, {n_if('severity = ' + repr('WARNING'))} AS warning_count, {n_if('severity = ' + repr('INFO'))} AS info_count FROM logs WHERE {RANGE}")
def _(c):
    one = a.severity_totals(c.logs, AS_OF, ALL)
    return one.select("total_logs", "error_count", "warning_count", F.col("by_severity")["INFO"].alias("info_count"))


SERVICES = f"""SELECT {SERVICE} AS service, count(*) AS total, {n_if(ERR2)} AS errors, {n_if("severity = 'WARNING'")} AS warnings
    FROM logs WHERE {RANGE} GROUP BY 1 ORDER BY errors DESC, total DESC, service LIMIT 10"""


@query("service_distribution", SERVICES)
def _(c):
    return a.service_distribution(c.logs, AS_OF, ALL)


ERROR_TYPE = "nullif(regexp_extract(message, '^([A-Za-z]+Error|Exception|[A-Z][a-z]+Exception):?', 1), '')"


@query(
    "error_patterns",
    f"""SELECT service, error_type, count(*) AS occurrences, min(event_timestamp) AS first_seen, max(event_timestamp) AS last_seen
        FROM (SELECT {SERVICE} AS service, {ERROR_TYPE} AS error_type, event_timestamp FROM logs WHERE {RANGE} AND {ERR2} AND message IS NOT NULL) AS x
        WHERE error_type IS NOT NULL GROUP BY 1, 2 ORDER BY occurrences DESC, service, error_type LIMIT 10""",
)
def _(c):
    return a.error_patterns(c.logs, AS_OF, ALL)


@query(
    "recommendations",
    f"""WITH s AS ({SERVICES}), w AS (SELECT * FROM s ORDER BY errors DESC, total DESC LIMIT 1), e AS (SELECT count(*) AS n FROM logs WHERE {RANGE} AND {ERR2})
        SELECT 'high' AS priority, 'Investigate ' || n || ' errors in the last 31d' AS action, 'Focus on the top error patterns identified' AS details FROM e WHERE n > 0
        UNION ALL SELECT 'high', 'Review service ''' || service || '''', 'This service has ' || errors || ' errors' FROM w WHERE errors > 5""",
)
def _(c):
    return a.recommendations(c.logs, AS_OF, ALL, "31d")


@query(
    "log_summary",
    f"""SELECT *, CASE WHEN error_rate_percent > 5 THEN 'critical' WHEN error_rate_percent > 1 THEN 'warning' WHEN errors > 0 THEN 'fair' ELSE 'healthy' END AS health_status FROM (
        SELECT count(*) AS total_logs, {n_if(ERR2)} AS errors, {n_if("severity = 'WARNING'")} AS warnings, {n_if("severity = 'INFO'")} AS info,
        count(DISTINCT service_name) AS services_active, min(event_timestamp) AS earliest, max(event_timestamp) AS latest,
        {r(f"{n_if(ERR2)} * 100.0 / count(*)", 2)} AS error_rate_percent FROM logs WHERE {RANGE}) AS x""",
)
def _(c):
    return rounded(a.log_summary(c.logs, AS_OF, ALL), "error_rate_percent", digits=2)


def _hourly_sql(where: str) -> str:
    return f"""SELECT log_date, date_trunc('hour', event_timestamp) AS hour, service_name, environment, severity, count(*) AS log_count, {n_if('is_error')} AS error_count,
        {n_if('is_request')} AS request_count, {r('avg(http_latency_ms)')} AS avg_latency_ms, quantile_disc(http_latency_ms, 0.5) AS p50_latency_ms,
        quantile_disc(http_latency_ms, 0.95) AS p95_latency_ms, quantile_disc(http_latency_ms, 0.99) AS p99_latency_ms FROM o_normal WHERE {where} GROUP BY ALL"""


@query("services_hourly", _hourly_sql("log_date IS NOT NULL"))
def _(c):
    return rounded(a.services_hourly(unified(c)), "avg_latency_ms")


@query("services_hourly_requests", _hourly_sql("log_date IS NOT NULL AND (http_latency_ms IS NOT NULL OR is_request)"))
def _(c):
    return rounded(a.services_hourly(unified(c), requests_only=True), "avg_latency_ms")


DAILY_KEYS = ["service_name", "environment", "severity"]


@query(
    "services_by_day_summaries",
    f"""SELECT service_name, environment, severity, count(*) AS log_count, {n_if('is_error')} AS error_count, {r('avg(http_latency_ms)')} AS avg_latency_ms, count(DISTINCT http_url) AS urls,
        quantile_disc(http_latency_ms, 0.5) AS p50_latency_ms, quantile_disc(http_latency_ms, 0.95) AS p95_latency_ms FROM o_normal WHERE log_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY ALL""",
)
def _(c):
    """Three days out of the stored summaries."""
    path = scratch_path(c.spark, "service-days")
    counts = {"errors": F.col("is_error").cast("int")}
    days = summaries.summarise(unified(c), "log_date", DAILY_KEYS, counts, {"url": F.col("http_url")}, {"latency": F.col("http_latency_ms")})
    summaries.store(days, path, "log_date")
    rows = summaries.merged(c.spark, path, DAILY_KEYS, "2024-01-10", "2024-01-12")
    measures = {"log_count": F.col("rows"), "error_count": F.col("errors"), "avg_latency_ms": summaries.mean("latency"), "urls": summaries.estimate("url"),
                "p50_latency_ms": summaries.quantile("latency", 0.5), "p95_latency_ms": summaries.quantile("latency", 0.95)}
    return rounded(rows.select(*DAILY_KEYS, *[e.alias(n) for n, e in measures.items()]), "avg_latency_ms")


ENDPOINTS = """SELECT service_name, request_url, status, count(*) AS error_count, min(event_timestamp) AS first_seen, max(event_timestamp) AS last_seen
    FROM requests WHERE severity = 'INFO' AND status >= 400 GROUP BY service_name, request_url, status"""


@query("errors_by_endpoint", ENDPOINTS)
def _(c):
    return a.errors_by_endpoint(c.requests, severity="INFO")


@query(
    "latency_p95_hourly",
    "SELECT service_name, request_url, date_trunc('hour', event_timestamp) AS hour, quantile_disc(latency_s, 0.95) AS p95_latency FROM requests WHERE latency_s IS NOT NULL GROUP BY ALL",
)
def _(c):
    return a.latency_p95_hourly(c.requests)


@query("requests_by_status_minute", "SELECT date_trunc('minute', event_timestamp) AS minute, status, count(*) AS count FROM requests GROUP BY ALL")
def _(c):
    return a.requests_by_status_minute(c.requests)


@query("top_endpoints_5xx", f"WITH e AS ({ENDPOINTS}) SELECT request_url, count(*) AS count FROM e WHERE status >= 500 GROUP BY request_url ORDER BY count DESC, request_url LIMIT 10")
def _(c):
    return a.top_endpoints_5xx(a.errors_by_endpoint(c.requests, severity="INFO"))


@query(
    "endpoint_errors_minute",
    """SELECT date_trunc('minute', event_timestamp) AS minute, request_url, count(*) AS count FROM requests WHERE status >= 500
       AND event_timestamp > TIMESTAMP '2024-01-01 00:00:00' GROUP BY ALL ORDER BY minute DESC, request_url LIMIT 200""",
)
def _(c):
    return a.endpoint_errors_minute(c.requests, AS_OF, minutes=30 * 24 * 60)


@query(
    "error_clusters",
    """WITH f AS (SELECT message, md5(coalesce(nullif(service_name, ''), 'unknown') || coalesce(message, '')) AS error_fingerprint FROM logs WHERE severity = 'ERROR')
       SELECT error_fingerprint, message, count(*) AS count FROM f GROUP BY ALL ORDER BY count DESC, error_fingerprint LIMIT 20""",
)
def _(c):
    from lumenlog.functions.columns import first_present

    key = F.md5(F.concat(first_present("service_name", F.lit("unknown")), F.coalesce("message", F.lit(""))))
    return a.error_clusters(c.logs.withColumn("error_fingerprint", key))


@query("audit_anomalies_hourly", "SELECT date_trunc('hour', event_timestamp) AS hour, count(*) AS count FROM audit WHERE status = 'PERMISSION_DENIED' GROUP BY ALL")
def _(c):
    return a.audit_anomalies_hourly(c.audit)


@query(
    "service_health",
    f"""SELECT service_name, {n_if(ERR4)} AS error_count, {n_if("severity = 'WARNING'")} AS warning_count, count(*) AS total_count,
        {r(f"{n_if(ERR4)} / count(*) * 100")} AS error_rate, {r('avg(http_latency_ms)')} AS avg_latency_ms FROM logs_rich WHERE {SINCE} GROUP BY service_name""",
)
def _(c):
    return rounded(a.service_health(c.logs_rich, AS_OF, ALL), "error_rate", "avg_latency_ms")


@query("service_errors_on", f"SELECT service_name, count(*) AS error_count FROM logs WHERE log_date = DATE '2024-01-15' AND {ERR2} GROUP BY ALL")
def _(c):
    return a.service_errors_on(c.logs, "2024-01-15")


@query(
    "error_insights",
    f"""WITH t AS (SELECT * FROM logs WHERE {ERR4} AND event_timestamp >= TIMESTAMP '2024-01-01 00:00:00'),
        g AS (SELECT coalesce(service_name, 'unknown') AS service, count(*) AS error_count FROM t GROUP BY 1)
        SELECT 'high_error_rate' AS type, CASE WHEN error_count < 50 THEN 'warning' ELSE 'critical' END AS severity, service, error_count FROM g WHERE error_count >= 10""",
)
def _(c):
    return a.error_insights(c.logs, "2024-01-01 00:00:00")


def _metrics_sql(cond: str, suffix: str = "") -> str:
    done, jobs = n_if(f"{cond} AND status = 'COMPLETED'"), n_if(cond)
    return f"""{jobs} AS total_jobs{suffix}, {done} AS completed_jobs{suffix}, {n_if(f"{cond} AND status = 'FAILED'")} AS failed_jobs{suffix},
        CAST(coalesce(sum(total_loaded) FILTER (WHERE {cond}), 0) AS BIGINT) AS total_logs_loaded{suffix},
        CAST(coalesce(sum(error_count) FILTER (WHERE {cond}), 0) AS BIGINT) AS total_errors{suffix}, {r(f"coalesce({done} * 100.0 / nullif({jobs}, 0), 0)")} AS success_rate{suffix}"""


@query("job_metrics", f"SELECT {_metrics_sql('true')} FROM etl_jobs WHERE started_at >= TIMESTAMP '2023-12-31 00:00:00'")
def _(c):
    return rounded(a.job_metrics(c.etl_jobs, AS_OF, ALL), "success_rate")


@query(
    "job_dashboard",
    f"""SELECT {_metrics_sql("started_at >= TIMESTAMP '2024-01-30 00:00:00'", '_24h')}, {_metrics_sql('true', '_7d')} FROM etl_jobs WHERE started_at >= TIMESTAMP '2024-01-24 00:00:00'""",
)
def _(c):
    return rounded(a.job_dashboard(c.etl_jobs, AS_OF), "success_rate_24h", "success_rate_7d")


@query(
    "stream_run_counts",
    f"""SELECT stream_id, count(*) AS extracted, {n_if('event_timestamp IS NOT NULL')} AS normalized, {n_if('event_timestamp IS NOT NULL AND service_name IS NOT NULL')} AS loaded
        FROM logs GROUP BY ROLLUP (stream_id)""",
)
def _(c):
    return a.stream_run_counts(c.logs)


@query("count_records", f"SELECT count(*) AS count FROM logs WHERE {SINCE}")
def _(c):
    return a.count_records(c.logs, AS_OF, ALL)


@query(
    "volume_rate",
    f"""SELECT date_trunc('minute', event_timestamp) AS window_start, source_table, {r('count(*) / 60.0')} AS entries_per_s, {r('sum(strlen(message)) / 60.0')} AS bytes_per_s,
        {r(n_if(ERR4) + ' / 60.0')} AS errors_per_s FROM logs WHERE event_timestamp IS NOT NULL GROUP BY ALL""",
)
def _(c):
    return rounded(a.volume_rate(c.logs), "entries_per_s", "bytes_per_s", "errors_per_s")


@query("server_error_rate", f"SELECT date_trunc('minute', event_timestamp) AS window_start, service_name, {r('count(*) / 60.0')} AS errors_per_s FROM requests WHERE status >= 500 GROUP BY ALL")
def _(c):
    return rounded(a.server_error_rate(c.requests), "errors_per_s")


@query(
    "facets",
    """WITH x AS (SELECT * FROM logs WHERE event_timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'),
       s AS (SELECT 'service' AS facet, service_name AS value, count(*) AS count FROM x GROUP BY ALL ORDER BY count DESC, value NULLS FIRST LIMIT 10)
       SELECT 'severity' AS facet, severity AS value, count(*) AS count FROM x GROUP BY ALL UNION ALL SELECT * FROM s
       UNION ALL SELECT 'source_table', source_table, count(*) FROM x GROUP BY ALL""",
)
def _(c):
    return a.facets(c.logs, "2024-01-01 00:00:00", AS_OF)


@query("errors_by_service_recent", f"SELECT service_name, count(*) AS errors FROM logs WHERE {SINCE} AND {ERR4} GROUP BY 1 ORDER BY errors DESC, service_name NULLS FIRST LIMIT 10")
def _(c):
    return a.errors_by_service_recent(c.logs, AS_OF, ALL)


DIRECTION = """CASE WHEN contains(source_table, 'audit') THEN 'INTERNAL' WHEN contains(source_table, 'request') THEN 'INBOUND' WHEN contains(source_table, 'sink_error') THEN 'OUTBOUND' ELSE 'INTERNAL' END"""
FLOW = "CASE WHEN contains(source_table, 'stdout') OR contains(source_table, 'stderr') THEN 'REALTIME' ELSE 'BATCH' END"


@query(
    "stream_stats",
    f"SELECT stream_id, {DIRECTION} AS stream_direction, {FLOW} AS stream_flow, count(*) AS count, min(event_timestamp) AS earliest, max(event_timestamp) AS latest FROM logs GROUP BY 1, 2, 3",
)
def _(c):
    from lumenlog.sources.io import stream_direction, stream_flow

    return a.stream_stats(c.logs.withColumns({"stream_direction": stream_direction("source_table"), "stream_flow": stream_flow("source_table")}))


@query("log_type_counts", f"SELECT {log_type_sql('source_table')} AS log_type, count(*) AS count FROM logs GROUP BY 1")
def _(c):
    return c.logs.groupBy(n.log_type("source_table").alias("log_type")).agg(F.count("*").alias("count"))
