"""Counts, rates and rankings over log rows.

All of them combine map-side before the shuffle, so a service or severity that holds a third of the rows costs no more than
any other; rankings run on the aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.contracts import COUNTABLE_FIELDS, ERROR_SEVERITIES, ERROR_TYPE_PATTERN
from lumenlog.functions.columns import count_if, extract, first_present, literal_like
from lumenlog.functions.stats import quantile
from lumenlog.functions.timewin import between, shift, since, within


def _is(severity: str) -> Column:
    return F.col("severity") == severity


def _error() -> Column:
    return F.col("severity").isin("ERROR", "CRITICAL")


def count_by_severity(df: DataFrame, as_of: str, hours: float, date: str | None = "log_date") -> DataFrame:
    return df.filter(within(df, as_of, hours, date=date)).groupBy("severity").agg(F.count("*").alias("count"))


def count_by_service(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    return df.filter(within(df, as_of, hours)).groupBy("service_name").agg(
        F.count("*").alias("count"), count_if(F.col("severity").isin(ERROR_SEVERITIES)).alias("error_count")
    )


def source_table_stats(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    return df.filter(within(df, as_of, hours)).groupBy("source_table", "stream_id").agg(F.count("*").alias("count"))


def count_by(df: DataFrame, field: str) -> DataFrame:
    if field not in COUNTABLE_FIELDS:
        raise ValueError(f"cannot count by {field}; choose one of {COUNTABLE_FIELDS}")
    return df.groupBy(field).agg(F.count("*").alias("count"))


def count_by_service_severity(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    return df.filter(within(df, as_of, hours)).groupBy("service_name", "severity").agg(F.count("*").alias("count"))


def severity_totals(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    """One row: total, errors, warnings and the count of every severity that occurs."""
    rows = df.filter(between(df, as_of, hours)).groupBy("severity").agg(F.count("*").alias("n"))
    return rows.agg(
        F.sum("n").alias("total_logs"),
        F.coalesce(F.sum(F.when(_error(), F.col("n"))), F.lit(0)).alias("error_count"),
        F.coalesce(F.sum(F.when(_is("WARNING"), F.col("n"))), F.lit(0)).alias("warning_count"),
        F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("by_severity"),
    )


def service_distribution(df: DataFrame, as_of: str, hours: float, limit: int = 10) -> DataFrame:
    service = first_present("service_name", F.lit("unknown"))
    counts = df.filter(between(df, as_of, hours)).groupBy(service.alias("service")).agg(
        F.count("*").alias("total"), count_if(_error()).alias("errors"), count_if(_is("WARNING")).alias("warnings")
    )
    return counts.orderBy(F.desc("errors"), F.desc("total"), "service").limit(limit)


def error_patterns(df: DataFrame, as_of: str, hours: float, limit: int = 10) -> DataFrame:
    """Errors grouped by the type their message starts with."""
    kind = extract("message", ERROR_TYPE_PATTERN).alias("error_type")
    rows = df.filter(between(df, as_of, hours) & _error() & F.col("message").isNotNull())
    rows = rows.select(first_present("service_name", F.lit("unknown")).alias("service"), kind, "event_timestamp")
    grouped = rows.filter(F.col("error_type").isNotNull()).groupBy("service", "error_type").agg(
        F.count("*").alias("occurrences"), F.min("event_timestamp").alias("first_seen"), F.max("event_timestamp").alias("last_seen")
    )
    return grouped.orderBy(F.desc("occurrences"), "service", "error_type").limit(limit)


def recommendations(df: DataFrame, as_of: str, hours: float, timeframe: str) -> DataFrame:
    """What to look at first: any errors at all, and the worst service when it has more than five."""
    top = service_distribution(df, as_of, hours)
    worst = top.agg(F.max_by("service", F.struct("errors", "total")).alias("service"), F.max("errors").alias("errors"))
    total = df.filter(between(df, as_of, hours) & _error()).agg(F.count("*").alias("n"))
    first = total.filter(F.col("n") > 0).select(
        F.lit("high").alias("priority"),
        F.concat(F.lit("Investigate "), F.col("n"), F.lit(f" errors in the last {timeframe}")).alias("action"),
        F.lit("Focus on the top error patterns identified").alias("details"),
    )
    second = worst.filter(F.col("errors") > 5).select(
        F.lit("high").alias("priority"),
        F.concat(F.lit("Review service '"), F.col("service"), F.lit("'")).alias("action"),
        F.concat(F.lit("This service has "), F.col("errors"), F.lit(" errors")).alias("details"),
    )
    return first.unionByName(second)


def log_summary(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    """Totals, error rate and a health word for the window, in one pass."""
    one = df.filter(between(df, as_of, hours)).agg(
        F.count("*").alias("total_logs"),
        count_if(_error()).alias("errors"),
        count_if(_is("WARNING")).alias("warnings"),
        count_if(_is("INFO")).alias("info"),
        F.count_distinct("service_name").alias("services_active"),
        F.min("event_timestamp").alias("earliest"),
        F.max("event_timestamp").alias("latest"),
    )
    rate = F.coalesce(F.try_divide(F.col("errors") * 100.0, F.col("total_logs")), F.lit(0.0))
    health = (
        F.when(rate > 5, "critical").when(rate > 1, "warning").when(F.col("errors") > 0, "fair").otherwise("healthy")
    )
    return one.withColumns({"error_rate_percent": rate, "health_status": health})


def services_hourly(df: DataFrame, requests_only: bool = False) -> DataFrame:
    """Volume, errors and latency per day, hour, service, environment and severity."""
    rows = df.filter(F.col("log_date").isNotNull())
    if requests_only:
        rows = rows.filter(F.col("http_latency_ms").isNotNull() | F.col("is_request"))
    hour = F.date_trunc("HOUR", "event_timestamp")
    keys, value = ["log_date", "hour", "service_name", "environment", "severity"], F.col("http_latency_ms")
    # Rows of a latency are counted before they are moved; only their counts are sorted, and no sketch of a small group is sent around.
    counted = rows.withColumn("hour", hour).groupBy(*keys, "http_latency_ms").agg(
        F.count("*").alias("log_count"), count_if(F.col("is_error")).alias("error_count"), count_if(F.col("is_request")).alias("request_count"), F.count("http_latency_ms").alias("_n")
    )
    group = Window.partitionBy(*keys)
    counted = counted.withColumns({"_upto": F.sum("_n").over(group.orderBy("http_latency_ms")), "_all": F.sum("_n").over(group)})
    at = lambda f: F.min(F.when(F.col("_upto") >= F.ceil(F.lit(f) * F.col("_all")), value))
    return counted.groupBy(*keys).agg(
        F.sum("log_count").alias("log_count"),
        F.sum("error_count").alias("error_count"),
        F.sum("request_count").alias("request_count"),
        F.try_divide(F.sum(value * F.col("_n")), F.sum("_n")).alias("avg_latency_ms"),
        at(0.50).alias("p50_latency_ms"),
        at(0.95).alias("p95_latency_ms"),
        at(0.99).alias("p99_latency_ms"),
    )


def errors_by_endpoint(df: DataFrame, severity: str = "ERROR") -> DataFrame:
    return df.filter(_is(severity) & (F.col("status") >= 400)).groupBy("service_name", "request_url", "status").agg(
        F.count("*").alias("error_count"), F.min("event_timestamp").alias("first_seen"), F.max("event_timestamp").alias("last_seen")
    )


def latency_p95_hourly(df: DataFrame) -> DataFrame:
    hour = F.date_trunc("HOUR", "event_timestamp").alias("hour")
    return df.filter(F.col("latency_s").isNotNull()).groupBy("service_name", "request_url", hour).agg(
        quantile("latency_s", 0.95).alias("p95_latency")
    )


def requests_by_status_minute(df: DataFrame, service: str | None = None) -> DataFrame:
    rows = df if service is None else df.filter(F.col("service_name") == service)
    return rows.groupBy(F.date_trunc("MINUTE", "event_timestamp").alias("minute"), "status").agg(F.count("*").alias("count"))


def top_endpoints_5xx(by_endpoint: DataFrame, limit: int = 10) -> DataFrame:
    """URLs with the most failing (service, URL, status) groups; counts groups, not events."""
    counts = by_endpoint.filter(F.col("status") >= 500).groupBy("request_url").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "request_url").limit(limit)


def endpoint_errors_minute(df: DataFrame, as_of: str, minutes: int = 60, limit: int = 200, service: str | None = None) -> DataFrame:
    rows = df.filter((F.col("status") >= 500) & (F.col("event_timestamp") > literal_like(df, "event_timestamp", shift(as_of, minutes=-minutes))))
    if service:
        rows = rows.filter(F.col("service_name") == service)
    counts = rows.groupBy(F.date_trunc("MINUTE", "event_timestamp").alias("minute"), "request_url").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("minute"), "request_url").limit(limit)


def error_clusters(df: DataFrame, limit: int = 20) -> DataFrame:
    counts = df.filter(_is("ERROR")).groupBy("error_fingerprint", "message").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "error_fingerprint").limit(limit)


def audit_anomalies_hourly(df: DataFrame) -> DataFrame:
    denied = df.filter(F.col("status") == "PERMISSION_DENIED")
    return denied.groupBy(F.date_trunc("HOUR", "event_timestamp").alias("hour")).agg(F.count("*").alias("count"))


def service_health(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    errors, total = count_if(F.col("severity").isin(ERROR_SEVERITIES)), F.count("*")
    return df.filter(within(df, as_of, hours)).groupBy("service_name").agg(
        errors.alias("error_count"),
        count_if(_is("WARNING")).alias("warning_count"),
        total.alias("total_count"),
        (F.try_divide(errors, total) * 100).alias("error_rate"),
        F.avg("http_latency_ms").alias("avg_latency_ms"),
    )


def service_errors_on(df: DataFrame, day: str) -> DataFrame:
    return df.filter((F.col("log_date") == F.to_date(F.lit(day))) & _error()).groupBy("service_name").agg(F.count("*").alias("error_count"))


def error_insights(df: DataFrame, since_ts: str) -> DataFrame:
    """Services that show up often among all errors of the day."""
    rows = df.filter(F.col("severity").isin(ERROR_SEVERITIES) & (F.col("event_timestamp") >= literal_like(df, "event_timestamp", since_ts)))
    counts = rows.groupBy(F.coalesce("service_name", F.lit("unknown")).alias("service")).agg(F.count("*").alias("error_count"))
    return counts.filter(F.col("error_count") >= 10).select(
        F.lit("high_error_rate").alias("type"), F.when(F.col("error_count") < 50, "warning").otherwise("critical").alias("severity"), "service", "error_count"
    )


def _job_metrics(condition: Column, suffix: str = "") -> list[Column]:
    done, jobs = count_if(condition & (F.col("status") == "COMPLETED")), count_if(condition)
    return [
        jobs.alias(f"total_jobs{suffix}"),
        done.alias(f"completed_jobs{suffix}"),
        count_if(condition & (F.col("status") == "FAILED")).alias(f"failed_jobs{suffix}"),
        F.coalesce(F.sum(F.when(condition, F.col("total_loaded"))), F.lit(0)).alias(f"total_logs_loaded{suffix}"),
        F.coalesce(F.sum(F.when(condition, F.col("error_count"))), F.lit(0)).alias(f"total_errors{suffix}"),
        F.coalesce(F.try_divide(done, jobs) * 100, F.lit(0.0)).alias(f"success_rate{suffix}"),
    ]


def job_metrics(jobs: DataFrame, as_of: str, hours: float) -> DataFrame:
    return jobs.filter(since(jobs, "started_at", as_of, hours=hours)).agg(*_job_metrics(F.lit(True)))


def job_dashboard(jobs: DataFrame, as_of: str) -> DataFrame:
    """One day and one week side by side, from one scan."""
    rows = jobs.filter(since(jobs, "started_at", as_of, hours=168))
    return rows.agg(*_job_metrics(since(jobs, "started_at", as_of, hours=24), "_24h"), *_job_metrics(F.lit(True), "_7d"))


def stream_run_counts(df: DataFrame) -> DataFrame:
    """Extracted, normalised and loadable rows per stream, with the grand total under a null stream."""
    return df.rollup("stream_id").agg(
        F.count("*").alias("extracted"),
        count_if(F.col("event_timestamp").isNotNull()).alias("normalized"),
        count_if(F.col("event_timestamp").isNotNull() & F.col("service_name").isNotNull()).alias("loaded"),
    )


def count_records(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    return df.filter(within(df, as_of, hours)).agg(F.count("*").alias("count"))


def volume_rate(df: DataFrame, size: str = "60 seconds", seconds: int = 60) -> DataFrame:
    """Entries, bytes and errors per second, per window and log name."""
    window = F.window("event_timestamp", size)["start"].alias("window_start")
    return df.filter(F.col("event_timestamp").isNotNull()).groupBy(window, "source_table").agg(
        (F.count("*") / seconds).alias("entries_per_s"),
        (F.sum(F.octet_length("message")) / seconds).alias("bytes_per_s"),
        (count_if(F.col("severity").isin(ERROR_SEVERITIES)) / seconds).alias("errors_per_s"),
    )


def server_error_rate(requests: DataFrame, size: str = "60 seconds", seconds: int = 60) -> DataFrame:
    """Server errors per second and window of each service; windows without any are left out."""
    window = F.window("event_timestamp", size)["start"].alias("window_start")
    failed = requests.filter(F.col("event_timestamp").isNotNull() & (F.col("status") >= 500))
    return failed.groupBy(window, "service_name").agg((F.count("*") / seconds).alias("errors_per_s"))


def facets(df: DataFrame, start: str, end: str, top_services: int = 10) -> DataFrame:
    """Counts by severity, by service (top ones) and by source table out of one scan."""
    ts = F.col("event_timestamp")
    rows = df.filter(ts.between(literal_like(df, "event_timestamp", start), literal_like(df, "event_timestamp", end)))
    keys = [F.col("severity"), F.col("service_name"), F.col("source_table")]
    sets = [[keys[0]], [keys[1]], [keys[2]]]
    counts = rows.groupingSets(sets, *keys).agg(F.count("*").alias("count"), F.grouping_id().alias("g"))
    named = counts.select(
        F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "service").otherwise("source_table").alias("facet"),
        F.coalesce("severity", "service_name", "source_table").alias("value"),
        "count",
    )
    services = named.filter(F.col("facet") == "service").orderBy(F.desc("count"), "value").limit(top_services)
    return named.filter(F.col("facet") != "service").unionByName(services)


def errors_by_service_recent(df: DataFrame, as_of: str, hours: float, limit: int = 10) -> DataFrame:
    counts = df.filter(within(df, as_of, hours) & F.col("severity").isin(ERROR_SEVERITIES)).groupBy("service_name").agg(F.count("*").alias("errors"))
    return counts.orderBy(F.desc("errors"), "service_name").limit(limit)


def stream_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("stream_id", "stream_direction", "stream_flow").agg(
        F.count("*").alias("count"), F.min("event_timestamp").alias("earliest"), F.max("event_timestamp").alias("latest")
    )
