"""One trace view over logs, job cost, tool calls and policies; context of errors; span latency; alert rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.columns import col, count_if, literal_like
from lumenlog.functions.ordered import running_sum, with_position
from lumenlog.functions.stats import quantile
from lumenlog.functions.timewin import shift
from lumenlog.session import materialize

TRACE_COLUMNS = {
    "trace_id": "string",
    "span_id": "string",
    "correlation_id": "string",
    "event_ts": "timestamp",
    "severity": "string",
    "service_name": "string",
    "project_id": "string",
    "resource_type": "string",
    "user_id": "string",
    "cost_usd": "double",
    "is_error": "boolean",
    "source_system": "string",
    "source_dataset": "string",
    "source_table": "string",
    "etl_job_id": "string",
    "etl_version": "string",
}


def _trace_rows(df: DataFrame, **given: Column | str) -> DataFrame:
    return df.select(*[col(given.get(name, F.lit(None))).cast(kind).alias(name) for name, kind in TRACE_COLUMNS.items()])


def log_traces(facts: DataFrame) -> DataFrame:
    return _trace_rows(
        facts, trace_id="trace_id", span_id="span_id", correlation_id="correlation_id", event_ts="event_timestamp", severity="severity",
        service_name="service_name", resource_type="resource_type", user_id="user_id", is_error="is_error", source_system=F.lit("logs"),
        source_dataset="source_dataset", source_table="source_table", etl_version="etl_version",
    )


def job_traces(jobs: DataFrame, dataset: str = "finops", table: str = "jobs_daily") -> DataFrame:
    key = F.sha2(F.concat("project_id", F.lit("-"), F.col("dt").cast("string"), F.lit("-"), "job_id"), 256)
    return _trace_rows(
        jobs, trace_id=key, correlation_id="job_id", event_ts="dt", severity=F.lit("INFO"), service_name=F.lit("bigquery"), project_id="project_id",
        resource_type=F.lit("bigquery_job"), user_id="user_name", cost_usd=F.col("total_bytes_processed") * F.lit(1e-9), is_error=F.lit(False),
        source_system=F.lit("finops"), source_dataset=F.lit(dataset), source_table=F.lit(table), etl_job_id="job_id", etl_version=F.lit("v2"),
    )


def tool_traces(tools: DataFrame, dataset: str = "agent") -> DataFrame:
    return _trace_rows(
        tools, trace_id=F.coalesce("trace_id", "invocation_id"), correlation_id="session_id", event_ts="started_at", severity=F.lit("INFO"),
        service_name="tool_name", resource_type=F.lit("agent_tool"), user_id="user_id", is_error=F.col("status").isin("error", "failure"),
        source_system=F.lit("agent"), source_dataset=F.lit(dataset), source_table=F.lit("tool_invocations"), etl_job_id="invocation_id",
        etl_version=F.lit("1.0.0"),
    )


def policy_traces(policies: DataFrame, dataset: str = "enterprise") -> DataFrame:
    return _trace_rows(
        policies, correlation_id=F.concat("project_id", F.lit(":"), "resource"), event_ts="policy_snapshot_date", severity=F.lit("INFO"),
        service_name=F.lit("policy"), project_id="project_id", resource_type=F.lit("policy_binding"), user_id="member", is_error=F.lit(False),
        source_system=F.lit("org_model"), source_dataset=F.lit(dataset), source_table=F.lit("fact_policy"), etl_version=F.lit("v1"),
    )


def traces_unified(facts: DataFrame, jobs: DataFrame, tools: DataFrame, policies: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [log_traces(facts), job_traces(jobs), tool_traces(tools), policy_traces(policies)])


def cross_system_traces(traces: DataFrame) -> DataFrame:
    """Traces seen in more than one system. At most four systems exist, so the list stays short however hot a trace is."""
    pairs = traces.filter(F.col("trace_id").isNotNull()).select("trace_id", "source_system").distinct()
    lists = pairs.groupBy("trace_id").agg(
        F.count("*").alias("systems_in_trace"), F.array_join(F.sort_array(F.collect_list("source_system")), ",").alias("systems_list")
    )
    return lists.filter(F.col("systems_in_trace") > 1)


def system_summary(traces: DataFrame) -> DataFrame:
    return traces.groupBy("source_system").agg(
        F.count("*").alias("total_events"),
        F.count_distinct("trace_id").alias("unique_traces"),
        F.count_distinct("correlation_id").alias("unique_correlations"),
        F.count_distinct("user_id").alias("unique_users"),
        F.avg(F.col("is_error").cast("int")).alias("error_rate"),
        F.min("event_ts").alias("earliest_event"),
        F.max("event_ts").alias("latest_event"),
    )


def related_logs(anchors: DataFrame, logs: DataFrame, minutes: int = 30, limit: int = 50) -> DataFrame:
    """Rows of the anchor's service within ± ``minutes`` of it, the first ``limit`` per anchor.

    Rows are numbered by time inside their service, and the anchors' starts are sorted in among them, which tells each anchor the
    number of its first row. From there it needs ``limit`` numbers, so it meets the rows of two blocks of numbers at most: the work
    follows the result, however many rows and anchors a service has. One sort of narrow rows; a service may span many tasks.
    """
    span = F.make_dt_interval(mins=F.lit(minutes))
    ts = F.col("event_timestamp").cast("timestamp")
    rows = logs.filter("service_name IS NOT NULL AND event_timestamp IS NOT NULL").select(
        "service_name", ts.alias("_at"), F.lit(1).alias("_row"), F.col("log_id"), "event_timestamp", "severity",
        F.substring(F.coalesce("message", F.lit("")), 1, 200).alias("message"), "trace_id", F.lit(None).cast("timestamp").alias("anchor_ts"),
    )
    starts = anchors.filter("service_name IS NOT NULL AND event_timestamp IS NOT NULL").select(
        "service_name", (ts - span).alias("_at"), F.lit(0).alias("_row"), F.col("log_id").cast(logs.schema["log_id"].dataType).alias("log_id"), ts.alias("anchor_ts")
    )
    placed = with_position(rows.unionByName(starts, allowMissingColumns=True), [F.col(c) for c in ("service_name", "_at", "_row", "log_id")], "_place")
    counted = running_sum(placed, ["service_name"], "_place", "_row", "_upto")
    counted = materialize(counted.withColumn("_number", F.col("_upto") - F.col("_row")), "related-logs")
    block = F.floor(F.col("_number") / limit)
    held = counted.filter("_row = 1").drop("anchor_ts", "_at", "_row", "_place", "_upto").withColumn("_block", block)
    asked = counted.filter("_row = 0").select(
        "service_name", F.col("log_id").alias("anchor_id"), "anchor_ts", F.col("_number").alias("_first"), F.explode(F.sequence(block, F.floor((F.col("_number") + limit - 1) / limit))).alias("_block")
    )
    inside = F.col("_number").between(F.col("_first"), F.col("_first") + (limit - 1)) & (ts <= F.col("anchor_ts") + span)
    return held.join(asked, ["service_name", "_block"]).filter(inside).select(
        "anchor_id", "log_id", "event_timestamp", "severity", "service_name", "message", "trace_id", (ts == F.col("anchor_ts")).alias("is_error"),
        (F.col("_number") - F.col("_first") + 1).cast("int").alias("rn"),
    )


def trace_context(anchors: DataFrame, logs: DataFrame, limit: int = 30) -> DataFrame:
    """All rows of the anchor's trace, the first ``limit`` per anchor."""
    a = anchors.filter(F.col("trace_id").isNotNull()).select(F.col("log_id").alias("anchor_id"), "trace_id")
    # The first rows of a trace are the same for all its anchors, so they are picked before the join, however long the trace is.
    wanted = logs.join(a.select("trace_id").distinct(), "trace_id", "left_semi")
    first = wanted.withColumn("rn", F.row_number().over(Window.partitionBy("trace_id").orderBy("event_timestamp", "log_id"))).filter(F.col("rn") <= limit)
    return first.join(a, "trace_id").select(
        "anchor_id", "log_id", "event_timestamp", "severity", "service_name", "span_id", F.substring(F.coalesce("message", F.lit("")), 1, 200).alias("message"), "rn"
    )


def span_latency(spans: DataFrame) -> DataFrame:
    """Duration and self time (duration minus that of the direct children) of every span.

    Children are summed per parent first, so a parent with very many children joins as one row.
    """
    children = spans.filter(F.col("parent_span_id").isNotNull()).groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(
        F.sum("duration_ms").alias("children_ms"), F.count("*").alias("child_count")
    )
    return spans.join(children, ["trace_id", "span_id"], "left").select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "service_name",
        "status",
        "duration_ms",
        F.coalesce("child_count", F.lit(0)).alias("child_count"),
        (F.col("duration_ms") - F.coalesce("children_ms", F.lit(0.0))).alias("self_ms"),
    )


def alert_rules(requests: DataFrame, logs: DataFrame, audit: DataFrame, as_of: str, minutes: tuple[int, int, int, int] = (5, 60, 10, 60)) -> DataFrame:
    """The four threshold rules over their look-back windows: value, threshold, whether the rule fires."""

    def recent(df: DataFrame, back: int) -> DataFrame:
        return df.filter(F.col("event_timestamp") > literal_like(df, "event_timestamp", shift(as_of, minutes=-back)))

    errors = recent(logs, minutes[2]).filter(F.col("severity") == "ERROR").groupBy("error_fingerprint").agg(F.count("*").alias("n"))
    parts = [
        ("5xx Rate Alert", "critical", 10.0, recent(requests, minutes[0]).agg(count_if(F.col("status") >= 500).cast("double").alias("value")), ">"),
        ("Latency P95 Alert", "warning", 5.0, recent(requests, minutes[1]).agg(quantile("latency_s", 0.95).alias("value")), ">"),
        ("Error Cluster Growth", "warning", 1.0, errors.agg(count_if(F.col("n") > 5).cast("double").alias("value")), ">="),
        ("Audit Anomalies", "info", 5.0, recent(audit, minutes[3]).agg(count_if(F.col("status") == "PERMISSION_DENIED").cast("double").alias("value")), ">"),
    ]
    out = []
    for name, severity, threshold, df, condition in parts:
        fired = F.col("value") > threshold if condition == ">" else F.col("value") >= threshold
        out.append(
            df.select(
                F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "value", F.lit(threshold).alias("threshold"),
                F.coalesce(fired, F.lit(False)).alias("fired"),
            )
        )
    return reduce(DataFrame.unionByName, out)
