"""Named queries: data quality and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions.timewin import EVENTS_AS_OF as AS_OF
from lumenlog.operators import quality as q
from lumenlog.operators import tracing as t
from lumenlog.operators import summaries
from lumenlog.plans.oracle_views import SEVERITY_LIST
from lumenlog.plans.registry import query, r, rounded
from lumenlog.plans.shapes import canonical, unified
from lumenlog.plans.tracing_queries import traces
from lumenlog.session import scratch_path

ALL = 24 * 31
SINCE = "event_timestamp >= TIMESTAMP '2023-12-31 00:00:00'"
JOBS_AS_OF = "2001-11-05"


@query(
    "null_timestamp_rate",
    f"""SELECT source_table, count(*) AS total_rows, count(*) FILTER (WHERE event_timestamp IS NULL) AS null_timestamp_count,
        {r('count(*) FILTER (WHERE event_timestamp IS NULL) * 100.0 / count(*)')} AS null_timestamp_pct FROM canonical WHERE {SINCE} OR event_timestamp IS NULL
        GROUP BY source_table HAVING count(*) FILTER (WHERE event_timestamp IS NULL) > 0""",
)
def _(c):
    return rounded(q.null_timestamp_rate(canonical(c), AS_OF, ALL), "null_timestamp_pct")


@query("invalid_severity", f"SELECT source_table, severity, count(*) AS count FROM canonical WHERE {SINCE} AND severity NOT IN ({SEVERITY_LIST}) GROUP BY ALL")
def _(c):
    return q.invalid_severity(canonical(c), AS_OF, ALL)


MISSING = "count(*) FILTER (WHERE coalesce(service_name, '') = '')"


@query(
    "missing_service_rate",
    f"SELECT source_table, count(*) AS total_rows, {MISSING} AS missing_service_count, {r(MISSING + ' * 100.0 / count(*)')} AS missing_service_pct FROM canonical WHERE {SINCE} GROUP BY 1 HAVING {MISSING} > 0",
)
def _(c):
    return rounded(q.missing_service_rate(canonical(c), AS_OF, ALL), "missing_service_pct")


BAD_JSON = "count(*) FILTER (WHERE json_payload NOT IN ('', '{}') AND NOT json_valid(json_payload))"


@query(
    "invalid_json_rate",
    f"SELECT source_table, count(*) AS total_rows, {BAD_JSON} AS invalid_json_count, {r(BAD_JSON + ' * 100.0 / count(*)')} AS invalid_json_pct FROM logs WHERE {SINCE} GROUP BY 1 HAVING {BAD_JSON} > 0",
)
def _(c):
    return rounded(q.invalid_json_rate(c.logs, AS_OF, ALL), "invalid_json_pct")


DUPLICATES = f"""SELECT source_table, count(insert_id) AS duplicate_ids, CAST(sum(n) AS BIGINT) AS total_duplicate_rows FROM
    (SELECT insert_id, source_table, count(*) AS n FROM canonical WHERE {SINCE} GROUP BY ALL HAVING count(*) > 1) AS d GROUP BY 1"""


@query("duplicate_insert_ids", DUPLICATES)
def _(c):
    return q.duplicate_insert_ids(canonical(c), AS_OF, ALL)


@query(
    "ingestion_latency",
    f"""WITH s AS (SELECT source_table, CAST(date_sub('second', event_timestamp, receive_timestamp) AS BIGINT) AS s FROM canonical WHERE {SINCE} AND receive_timestamp IS NOT NULL)
        SELECT source_table, count(*) AS total_rows, {r('avg(s)')} AS avg_latency_sec, quantile_disc(s, 0.5) AS p50_latency_sec, quantile_disc(s, 0.95) AS p95_latency_sec,
        quantile_disc(s, 0.99) AS p99_latency_sec FROM s GROUP BY 1""",
)
def _(c):
    return rounded(q.ingestion_latency(canonical(c), AS_OF, ALL), "avg_latency_sec")


@query(
    "dq_summary",
    f"""WITH x AS (SELECT
        (SELECT count(*) FROM (SELECT source_table FROM canonical WHERE {SINCE} OR event_timestamp IS NULL GROUP BY 1 HAVING count(*) > count(event_timestamp))) AS tables_with_null_timestamps,
        (SELECT count(*) FROM (SELECT source_table, severity FROM canonical WHERE {SINCE} AND severity NOT IN ({SEVERITY_LIST}) GROUP BY ALL)) AS invalid_severity_count,
        (SELECT count(*) FROM (SELECT source_table FROM canonical WHERE {SINCE} GROUP BY 1 HAVING {MISSING} > 0)) AS tables_with_missing_service,
        (SELECT count(*) FROM ({DUPLICATES})) AS tables_with_duplicates)
        SELECT 'data_quality_summary' AS check_type, *, CASE WHEN tables_with_null_timestamps = 0 AND invalid_severity_count = 0 THEN 'HEALTHY' ELSE 'DEGRADED' END AS overall_status FROM x""",
)
def _(c):
    return q.dq_summary(canonical(c), AS_OF, ALL, ALL)


@query(
    "schema_coverage",
    """SELECT log_date, count(*) AS total_rows, count(log_id) AS has_event_id, count(event_timestamp) AS has_event_ts, count(service_name) AS has_service_name,
       count(trace_id) AS has_trace_id, count(principal_email) AS has_actor_user_id, count(coalesce(correlation_request_id, operation_id)) AS has_correlation_request_id,
       count(privacy_pii_risk) AS has_privacy_pii_risk FROM o_normal WHERE log_date >= DATE '2023-12-31' GROUP BY log_date""",
)
def _(c):
    return q.schema_coverage(unified(c), AS_OF, 31)


@query(
    "null_rates",
    f"""WITH x AS (SELECT count(*) AS n, count(log_id) AS a, count(event_timestamp) AS b, count(severity) AS c, count(service_name) AS d, count(nullif(message, '')) AS e FROM logs)
        SELECT 'log_id' AS field, {r('(n - a) / n', 6)} AS null_rate FROM x UNION ALL SELECT 'event_timestamp', {r('(n - b) / n', 6)} FROM x UNION ALL SELECT 'severity', {r('(n - c) / n', 6)} FROM x
        UNION ALL SELECT 'service_name', {r('(n - d) / n', 6)} FROM x UNION ALL SELECT 'message', {r('(n - e) / n', 6)} FROM x""",
)
def _(c):
    return rounded(q.null_rates(c.logs), "null_rate", digits=6)


@query(
    "ingest_latency_daily",
    f"""WITH s AS (SELECT log_date, CAST(date_sub('second', event_timestamp, etl_timestamp) AS BIGINT) AS s FROM logs WHERE log_date >= DATE '2023-12-31' AND event_timestamp IS NOT NULL)
        SELECT log_date, {r('avg(s)')} AS avg_latency_seconds, quantile_disc(s, 0.5) AS p50_latency_seconds, quantile_disc(s, 0.95) AS p95_latency_seconds, max(s) AS max_latency_seconds
        FROM s GROUP BY 1""",
)
def _(c):
    return rounded(q.ingest_latency_daily(c.logs, AS_OF, 31), "avg_latency_seconds")


def _marts(c):
    tools = c.tool_inv.withColumn("invocation_date", F.to_date("started_at"))
    assets = c.assets.withColumn("fetched_date", F.to_date("fetched_at"))
    return tools, assets


MARTS = """(SELECT 'fact_logs' AS name, log_date AS d, service_name AS entity FROM logs UNION ALL SELECT 'bq_jobs_daily', dt, project_id FROM jobs
    UNION ALL SELECT 'tool_invocations', CAST(started_at AS DATE), tool_name FROM tool_inv UNION ALL SELECT 'stg_asset_inventory', CAST(fetched_at AS DATE), asset_type FROM assets) AS m"""
NAMES = "(SELECT unnest(['fact_logs', 'bq_jobs_daily', 'tool_invocations', 'stg_asset_inventory']) AS name) AS n"


@query(
    "freshness",
    f"""SELECT n.name AS table_name, count(m.d) AS row_count, max(m.d) AS latest_date, CAST(DATE '2024-01-31' - max(m.d) AS INTEGER) AS days_old,
        CASE WHEN DATE '2024-01-31' - max(m.d) <= 1 THEN '✅ Fresh' WHEN DATE '2024-01-31' - max(m.d) <= 7 THEN '⚠️ Stale' ELSE '❌ Very Old' END AS freshness_status
        FROM {NAMES} LEFT JOIN {MARTS} ON n.name = m.name AND m.d >= DATE '2024-01-31' - 20000 GROUP BY 1""",
)
def _(c):
    tools, assets = _marts(c)
    marts = {"fact_logs": (c.logs, "log_date"), "bq_jobs_daily": (c.jobs, "dt"), "tool_invocations": (tools, "invocation_date"), "stg_asset_inventory": (assets, "fetched_date")}
    return q.freshness(marts, AS_OF, 20000)


@query(
    "partition_skew",
    f"""WITH p AS (SELECT name, d, count(*) AS n FROM {MARTS} WHERE name <> 'stg_asset_inventory' GROUP BY ALL)
        SELECT name AS table_name, count(*) AS partition_count, min(n) AS min_rows_per_partition, max(n) AS max_rows_per_partition, {r('avg(n)')} AS avg_rows_per_partition,
        {r('stddev_samp(n)')} AS stddev_rows, CASE WHEN stddev_samp(n) / avg(n) > 2 THEN '⚠️ High Skew' WHEN stddev_samp(n) / avg(n) > 1 THEN '⚠️ Moderate Skew' ELSE '✅ Balanced' END AS skew_status
        FROM p GROUP BY 1""",
)
def _(c):
    tools, _assets = _marts(c)
    marts = {"fact_logs": (c.logs, "log_date"), "bq_jobs_daily": (c.jobs, "dt"), "tool_invocations": (tools, "invocation_date")}
    return rounded(q.partition_skew(marts, AS_OF, 20000), "avg_rows_per_partition", "stddev_rows")


def _cluster_sql(name: str, table: str, *keys: str) -> str:
    combo = " || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    cards = [f"count(DISTINCT {k}) AS cluster_key_{i}_cardinality" for i, k in enumerate(keys, 1)]
    cards += [f"CAST(1 AS BIGINT) AS cluster_key_{i}_cardinality" for i in range(len(keys) + 1, 4)]
    return f"SELECT '{name} ({','.join(keys)})' AS table_cluster_config, count(*) AS total_rows, {', '.join(cards)}, count(*) / count(DISTINCT {combo}) AS x FROM {table}"


CLUSTERS = [("fact_logs", "logs", "severity", "service_name", "resource_type"), ("bq_jobs_daily", "jobs", "project_id", "statement_type", "cache_hit"), ("tool_invocations", "tool_inv", "tool_name", "user_id")]


@query(
    "cluster_effectiveness",
    f"""SELECT * EXCLUDE (x), {r('x')} AS avg_rows_per_cluster_combo, CASE WHEN x BETWEEN 100 AND 10000 THEN '✅ Good Clustering' WHEN x < 100 THEN '⚠️ Over-clustered' ELSE '⚠️ Under-clustered' END AS clustering_status
        FROM ({' UNION ALL '.join(_cluster_sql(*x) for x in CLUSTERS)}) AS u""",
)
def _(c):
    frames = {"logs": c.logs, "jobs": c.jobs, "tool_inv": c.tool_inv}
    return rounded(q.cluster_effectiveness({name: (frames[table], list(keys)) for name, table, *keys in CLUSTERS}), "avg_rows_per_cluster_combo")


CLUSTER_KEYS = ["severity", "service_name", "resource_type"]


@query(
    "cluster_effectiveness_by_day",
    f"SELECT table_cluster_config, total_rows, cluster_key_1_cardinality, cluster_key_2_cardinality, cluster_key_3_cardinality, {r('x')} AS avg_rows_per_cluster_combo FROM ({_cluster_sql('fact_logs', 'logs', *CLUSTER_KEYS)}) AS u",
)
def _(c):
    """Days are summarised in two goes, one day twice; the answer reads the summaries."""
    path = scratch_path(c.spark, "day-summaries")
    for days in ("log_date < DATE '2024-01-16'", "log_date >= DATE '2024-01-15'"):
        rows = c.logs.filter(days)
        sketches = {**{k: F.col(k) for k in CLUSTER_KEYS}, "combination": summaries.combination(CLUSTER_KEYS)}
        summaries.store(summaries.summarise(rows, "log_date", [], {}, sketches, {}), path, "log_date")
    return rounded(summaries.cluster_effectiveness(c.spark, path, "fact_logs", CLUSTER_KEYS), "avg_rows_per_cluster_combo")



@query(
    "label_compliance",
    """WITH l AS (SELECT json_extract_string(payload, '$.name') AS name, unnest(json_extract_string(payload, '$.labels[*].key')) AS k FROM assets)
       SELECT name, count(*) AS total_labels, count(*) FILTER (WHERE k = 'env') AS has_env_label, count(*) FILTER (WHERE k = 'team') AS has_team_label, count(*) FILTER (WHERE k = 'owner') AS has_owner_label,
       count(*) FILTER (WHERE k = 'data_product') AS has_data_product_label, count(*) FILTER (WHERE k = 'version') AS has_version_label,
       CASE WHEN count(*) FILTER (WHERE k IN ('env', 'team', 'owner', 'data_product', 'version')) >= 5 THEN '✅ Complete' ELSE '⚠️ Missing Required Labels' END AS label_compliance FROM l GROUP BY 1""",
)
def _(c):
    rows = c.assets.withColumn("name", F.get_json_object("payload", "$.name"))
    return q.label_compliance(rows, "name", F.get_json_object("payload", "$.labels"))


@query(
    "trace_connectivity",
    f"""WITH s AS (SELECT source_system, count(*) AS total_events, count(DISTINCT trace_id) AS tr, count(DISTINCT user_id) AS us, avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END) AS er FROM traces GROUP BY 1),
        x AS (SELECT trace_id, count(DISTINCT source_system) AS n, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS l FROM traces WHERE trace_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_system) > 1)
        SELECT 'Individual Systems' AS metric_type, source_system AS metric_name, CAST(total_events AS VARCHAR) AS value,
               'Traces: ' || tr || ', Users: ' || us || ', Error Rate: ' || printf('%.2f', {r('er * 100', 2)}) || '%' AS details FROM s
        UNION ALL SELECT 'Cross-System Tracing', 'Multi-system traces', CAST(count(*) AS VARCHAR), 'Avg systems per trace: ' || printf('%.1f', {r('coalesce(avg(n), 0)', 1)}) FROM x
        UNION ALL SELECT 'Cross-System Tracing', 'System combinations', CAST(count(DISTINCT l) AS VARCHAR), 'Unique system combinations found' FROM x""",
)
def _(c):
    rows = traces(c)
    return q.trace_connectivity(t.system_summary(rows), t.cross_system_traces(rows))


@query(
    "integrity_checks",
    f"""SELECT 'fact_logs completeness' AS check_name, CASE WHEN count(*) = count(log_id) THEN '✅ All log_ids present' ELSE '❌ Missing log_ids: ' || (count(*) - count(log_id)) END AS result,
        count(*) || ' total rows' AS details FROM logs
        UNION ALL SELECT 'fact_logs trace_id coverage', CASE WHEN count(trace_id) / count(*) >= 0.8 THEN '✅ Good trace coverage' ELSE '⚠️ Low trace coverage: ' || printf('%.1f', {r('count(trace_id) * 100.0 / count(*)', 1)}) || '%' END,
        count(trace_id) || ' of ' || count(*) || ' rows have trace_id' FROM logs
        UNION ALL SELECT 'enterprise staging data types', CASE WHEN count(DISTINCT asset_type) >= 5 THEN '✅ Diverse asset types' ELSE '⚠️ Limited asset types' END, count(DISTINCT asset_type) || ' asset types found' FROM assets
        UNION ALL SELECT 'finops data distribution', CASE WHEN count(DISTINCT project_id) >= 1 THEN '✅ Multi-project data' ELSE '⚠️ Single project only' END, count(DISTINCT project_id) || ' projects in FinOps data' FROM jobs""",
)
def _(c):
    return q.integrity_checks(c.logs, c.assets, c.jobs)


@query(
    "validation_summary",
    """WITH u AS (SELECT 'Logs' AS data_domain, count(*) AS total_rows, count(DISTINCT service_name) AS unique_entities, max(log_date) AS latest_data FROM logs
       UNION ALL SELECT 'FinOps', count(*), count(DISTINCT project_id), max(dt) FROM jobs UNION ALL SELECT 'Agent', count(*), count(DISTINCT tool_name), max(CAST(started_at AS DATE)) FROM tool_inv
       UNION ALL SELECT 'Enterprise', count(*), count(DISTINCT asset_type), max(CAST(fetched_at AS DATE)) FROM assets)
       SELECT *, CAST(DATE '2024-01-31' - latest_data AS INTEGER) AS days_behind, CASE WHEN total_rows > 0 AND DATE '2024-01-31' - latest_data <= 1 THEN '✅ Healthy'
       WHEN total_rows > 0 AND DATE '2024-01-31' - latest_data <= 7 THEN '⚠️ Stale' WHEN total_rows = 0 THEN '❌ No Data' ELSE '❌ Very Stale' END AS health_status FROM u""",
)
def _(c):
    tools, assets = _marts(c)
    marts = {
        "Logs": (c.logs, "service_name", "log_date"),
        "FinOps": (c.jobs, "project_id", "dt"),
        "Agent": (tools, "tool_name", "invocation_date"),
        "Enterprise": (assets, "asset_type", "fetched_date"),
    }
    return q.validation_summary(marts, AS_OF, 20000)


@query("row_parity", "SELECT count(*) AS rows_a, count(*) AS rows_b, true AS counts_equal, true AS content_equal FROM records")
def _(c):
    stored = unified(c)
    columns = ["log_id", "event_timestamp", "service_name", "message", "severity"]
    from lumenlog.plans.shapes import normalized

    return q.row_parity(normalized(c).select(*columns), stored.select(*columns)).select("rows_a", "rows_b", "counts_equal", "content_equal")
