"""Filtered, ordered and paged reads of log rows.

Every top-k is an ``orderBy(...).limit(n)``: each task keeps only its own first n rows, nothing is sorted as a whole.
The row id is always the last sort key, so ties come out the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.contracts import DEFAULT_HOURS, DEFAULT_LIMIT, DISPLAY_FIELDS, ERROR_SEVERITIES, MAX_HOURS, MAX_LIMIT, SEVERITIES
from lumenlog.functions.columns import count_if, first_present, literal_like
from lumenlog.functions.timewin import between, within


@dataclass
class ListParams:
    """Parameters of a log listing."""

    limit: int = DEFAULT_LIMIT
    hours: int = DEFAULT_HOURS
    severity: str | None = None
    service: str | None = None
    search: str | None = None
    source_table: str | None = None

    def problems(self, max_limit: int = MAX_LIMIT, max_hours: int = MAX_HOURS) -> list[str]:
        """What is wrong with the parameters, in words; empty when they are fine."""
        found = []
        if not 1 <= self.limit <= max_limit:
            found.append(f"limit must lie in 1..{max_limit}")
        if not 1 <= self.hours <= max_hours:
            found.append(f"hours must lie in 1..{max_hours}")
        if self.severity and self.severity.upper() not in SEVERITIES:
            found.append(f"unknown severity {self.severity}")
        return found

    def checked(self) -> ListParams:
        found = self.problems()
        if found:
            raise ValueError("; ".join(found))
        return self

    def clamped(self, max_limit: int = MAX_LIMIT, max_hours: int = MAX_HOURS) -> ListParams:
        """The same request forced into the allowed ranges."""
        limit = min(max(self.limit, 1), max_limit)
        hours = min(max(self.hours, 1), max_hours)
        return ListParams(limit, hours, self.severity, self.service, self.search, self.source_table)


def _newest(df: DataFrame, limit: int, ts: str = "event_timestamp", tie: str = "log_id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie)).limit(limit)


def _listing(df: DataFrame, params: ListParams, searched: list[str]) -> DataFrame:
    if params.severity:
        df = df.filter(F.col("severity") == params.severity.upper())
    if params.service:
        df = df.filter(F.col("service_name").contains(params.service))
    if params.search:
        hit = F.lit(False)
        for column in searched:
            hit = hit | F.coalesce(F.col(column).contains(params.search), F.lit(False))
        df = df.filter(hit)
    if params.source_table:
        df = df.filter(F.col("source_table") == params.source_table)
    return df


def list_logs(df: DataFrame, params: ListParams, as_of: str) -> DataFrame:
    """Newest rows of the unified table inside the look-back window."""
    params.checked()
    rows = _listing(df.filter(within(df, as_of, params.hours)), params, ["message", "json_payload"])
    return _newest(rows, params.limit).select(*DISPLAY_FIELDS)


def list_logs_envelope(df: DataFrame, params: ListParams, as_of: str) -> DataFrame:
    """The same over rows that carry the nested envelope, with its main fields flattened."""
    params.checked()
    rows = _listing(df.filter(within(df, as_of, params.hours)), params, ["message", "json_payload"])
    nested = {
        "envelope_event_id": "event_id",
        "envelope_event_ts": "event_ts",
        "envelope_service_name": "service.name",
        "envelope_trace_id": "trace.trace_id",
        "envelope_user_id": "actor.user_id",
        "envelope_pii_risk": "privacy.pii_risk",
        "envelope_environment": "environment",
        "envelope_request_id": "correlation.request_id",
        "envelope_session_id": "correlation.session_id",
    }
    flat = [F.col(f"universal_envelope.{path}").alias(name) for name, path in nested.items()]
    return _newest(rows, params.limit).select(*[c for c in DISPLAY_FIELDS if c in df.columns], *flat)


def list_canonical(df: DataFrame, params: ListParams, as_of: str) -> DataFrame:
    """Listing over the canonical contract: no partition column, search in the display message."""
    params.checked()
    rows = _listing(df.filter(within(df, as_of, params.hours, date=None)), params, ["display_message", "json_payload"])
    keep = ["event_timestamp", "severity", "service_name", "log_name", "display_message", "source_table", "insert_id", "trace_id", "span_id"]
    return rows.orderBy(F.col("event_timestamp").desc(), "insert_id", "source_table", "span_id").limit(params.limit).select(*keep)


def canonical_range(
    df: DataFrame, start: str, end: str, severity: str | None = None, service: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of a closed time range."""
    ts = F.col("event_timestamp")
    rows = df.filter(ts.between(literal_like(df, "event_timestamp", start), literal_like(df, "event_timestamp", end)))
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if service:
        rows = rows.filter(F.col("service_name") == service)
    return rows.orderBy(ts.desc(), "log_id").offset(offset).limit(limit)


def search_logs(
    df: DataFrame, text: str, as_of: str, severity: str | None = None, service: str | None = None, hours: int = 1, limit: int = 20
) -> DataFrame:
    """Case-insensitive search in message and JSON payload."""
    rows = df.filter(between(df, as_of, hours))
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if service:
        rows = rows.filter(F.col("service_name").contains(service))
    if text:
        needle = F.lit(text.lower())
        rows = rows.filter(F.lower("message").contains(needle) | F.coalesce(F.lower("json_payload").contains(needle), F.lit(False)))
    return _newest(rows, limit)


def top_errors(df: DataFrame, as_of: str, hours: float, limit: int = 25) -> DataFrame:
    rows = df.filter(between(df, as_of, hours) & F.col("severity").isin(ERROR_SEVERITIES))
    return _newest(rows, limit).select(
        F.col("event_timestamp").alias("timestamp"),
        "severity",
        first_present("service_name", F.lit("unknown")).alias("service"),
        F.substring(F.coalesce("message", F.lit("")), 1, 300).alias("message"),
        "trace_id",
        F.col("source_table").alias("source"),
        "resource_type",
        "log_id",
    )


def top_warnings(df: DataFrame, as_of: str, hours: float, limit: int = 15) -> DataFrame:
    rows = df.filter(between(df, as_of, hours) & (F.col("severity") == "WARNING"))
    return _newest(rows, limit).select(
        F.col("event_timestamp").alias("timestamp"),
        first_present("service_name", F.lit("unknown")).alias("service"),
        F.substring(F.coalesce("message", F.lit("")), 1, 200).alias("message"),
        "log_id",
    )


def recent_matching(df: DataFrame, pattern: str, as_of: str, days: int = 7, limit: int = 5) -> DataFrame:
    """Newest errors and warnings whose message holds ``pattern`` in any case."""
    rows = df.filter(
        (F.col("log_date") >= F.to_date(F.lit(as_of[:10])) - F.expr(f"INTERVAL {days} DAYS"))
        & F.lower("message").contains(pattern.lower())
        & F.col("severity").isin("ERROR", "CRITICAL", "WARNING")
    )
    return _newest(rows, limit).select(
        "log_id", "event_timestamp", "severity", "service_name", "trace_id", "span_id", "message", "source_table"
    )


def logs_by_trace(df: DataFrame, trace_id: str, limit: int = 100) -> DataFrame:
    return df.filter(F.col("trace_id") == trace_id).orderBy("event_timestamp", "log_id").limit(limit)


def log_by_id(df: DataFrame, log_id: str) -> DataFrame:
    return df.filter(F.col("log_id") == log_id).orderBy("event_timestamp").limit(1)


def log_by_insert_id(df: DataFrame, insert_id: str) -> DataFrame:
    return df.filter(F.col("insert_id") == insert_id).orderBy("event_timestamp", "log_id").limit(1)


def failed_requests(df: DataFrame, service: str, url_part: str) -> DataFrame:
    """Requests of one service to URLs holding ``url_part`` that ended in a server error."""
    return df.filter((F.col("service_name") == service) & F.col("request_url").contains(url_part) & (F.col("status") >= 500))


def trace_explorer(df: DataFrame, limit: int = 50) -> DataFrame:
    rows = df.filter(F.col("trace_id").isNotNull() & (F.col("severity") == "ERROR"))
    return _newest(rows, limit).select("log_id", "trace_id", "span_id", "event_timestamp", "message")


def errors_projection(df: DataFrame) -> DataFrame:
    """Rows of level ERROR and above without the two lineage columns."""
    return df.filter((F.col("severity_level") >= 500) & F.col("log_date").isNotNull()).drop("source_system", "source_view")


FACT_COLUMNS = (
    "log_id insert_id universal_envelope event_timestamp receive_timestamp etl_timestamp log_date severity severity_level log_type "
    "source_dataset source_table source_log_name stream_id service_name service_version service_method resource_type message "
    "message_summary message_category text_payload json_payload proto_payload audit_payload http_method http_url http_status "
    "http_latency_ms http_user_agent http_remote_ip http_request_size http_response_size trace_id span_id trace_sampled "
    "parent_span_id operation_id error_message error_code error_stack_trace error_group_id is_error is_audit is_request has_trace "
    "etl_version etl_batch_id etl_status"
).split()


def fact_logs(df: DataFrame, source_view: str = "envelope_logs") -> DataFrame:
    """The log fact: fixed projection plus a correlation id and lineage."""
    return df.filter(F.col("log_date").isNotNull()).select(
        *[F.col(c) for c in FACT_COLUMNS if c in df.columns],
        F.coalesce(F.col("universal_envelope.correlation.request_id"), F.col("trace_id")).alias("correlation_id"),
        F.lit("logs").alias("source_system"),
        F.lit(source_view).alias("source_view"),
    )


def tail(df: DataFrame, cursor_ts: str, cursor_id: str = "", limit: int = 10) -> DataFrame:
    """The next rows after a (timestamp, id) cursor, oldest first.

    The pair, rather than the timestamp alone, keeps rows that share the cursor's timestamp.
    """
    ts, at = F.col("event_timestamp"), literal_like(df, "event_timestamp", cursor_ts)
    return df.filter((ts > at) | ((ts == at) & (F.col("log_id") > cursor_id))).orderBy(ts, "log_id").limit(limit)


def list_by_status(df: DataFrame, owner: str, owner_column: str, status: str | None, updated: str, tie: str, limit: int = 20) -> DataFrame:
    """Latest updated records of one owner, optionally of one status."""
    rows = df.filter(F.col(owner_column) == owner)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.col(updated).desc(), tie).limit(limit)


def distinct_services(df: DataFrame) -> DataFrame:
    return df.select("service_name").distinct()


def unacknowledged_alerts(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Failed jobs nobody has looked at yet, newest first."""
    return _newest(jobs.filter((F.col("status") == "FAILED") & ~F.col("acknowledged")), limit, "started_at", "job_id")


def running_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "RUNNING")


def recent_jobs(jobs: DataFrame, limit: int = 20, status: str | None = None) -> DataFrame:
    rows = jobs if status is None else jobs.filter(F.col("status") == status)
    return _newest(rows, limit, "started_at", "job_id")


def save_view(df: DataFrame, name: str) -> None:
    """Keep a derived query under a name for the session."""
    df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, params: dict | None = None, max_rows: int = 1000, **frames: DataFrame) -> DataFrame:
    """Ad-hoc SQL with named typed parameters over the given frames, cut at ``max_rows``."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(text, args=params or {}).limit(max_rows)


def preview(df: DataFrame, limit: int = 5, width: int = 200, payloads: tuple[str, ...] = ("message", "json_payload")) -> DataFrame:
    """First rows of a stream, newest first, payloads shortened."""
    short = [F.substring(c, 1, width).alias(c) if c in payloads else F.col(c) for c in df.columns]
    return _newest(df, limit).select(*short)


def errors_by(df: DataFrame, condition: Column, *keys: str) -> DataFrame:
    """Rows and matching rows per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), count_if(condition).alias("matching"))
