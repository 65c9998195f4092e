"""Data-quality checks over the canonical rows and validation reports over the marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.contracts import (
    ALL_LOG_IDS,
    BALANCED,
    DIVERSE_ASSETS,
    FRESH,
    GOOD_CLUSTERING,
    GOOD_TRACES,
    HEALTH_STALE,
    HEALTHY,
    HIGH_SKEW,
    LABELS_COMPLETE,
    LABELS_MISSING,
    LIMITED_ASSETS,
    MODERATE_SKEW,
    MULTI_PROJECT,
    NO_DATA,
    OVER_CLUSTERED,
    REQUIRED_LABELS,
    SEVERITIES,
    SINGLE_PROJECT,
    STALE,
    UNDER_CLUSTERED,
    VERY_OLD,
    VERY_STALE,
)
from lumenlog.functions.columns import count_if
from lumenlog.functions.stats import quantile
from lumenlog.functions.timewin import day, days_back, since


def _percent(part: Column) -> Column:
    return F.try_divide(part, F.count("*")) * 100


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- canonical rows ---------------------------------------------------------------------------------------------------


def null_timestamp_rate(df: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    ts = F.col("event_timestamp")
    rows = df.filter(since(df, "event_timestamp", as_of, hours=hours) | ts.isNull())
    return (
        rows.groupBy("source_table")
        .agg(F.count("*").alias("total_rows"), count_if(ts.isNull()).alias("null_timestamp_count"), _percent(count_if(ts.isNull())).alias("null_timestamp_pct"))
        .filter(F.col("null_timestamp_count") > 0)
    )


def invalid_severity(df: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    rows = df.filter(since(df, "event_timestamp", as_of, hours=hours) & ~F.col("severity").isin(SEVERITIES))
    return rows.groupBy("source_table", "severity").agg(F.count("*").alias("count"))


def missing_service_rate(df: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    missing = count_if(F.coalesce("service_name", F.lit("")) == "")
    return (
        df.filter(since(df, "event_timestamp", as_of, hours=hours))
        .groupBy("source_table")
        .agg(F.count("*").alias("total_rows"), missing.alias("missing_service_count"), _percent(missing).alias("missing_service_pct"))
        .filter(F.col("missing_service_count") > 0)
    )


def invalid_json_rate(df: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    bad = count_if(~F.col("json_payload").isin("", "{}") & F.try_parse_json("json_payload").isNull())
    return (
        df.filter(since(df, "event_timestamp", as_of, hours=hours))
        .groupBy("source_table")
        .agg(F.count("*").alias("total_rows"), bad.alias("invalid_json_count"), _percent(bad).alias("invalid_json_pct"))
        .filter(F.col("invalid_json_count") > 0)
    )


def duplicate_insert_ids(df: DataFrame, as_of: str, hours: float = 1) -> DataFrame:
    """Ids that occur more than once, per source. Two aggregates; the first spreads by id, so a large source stays cheap."""
    ids = df.filter(since(df, "event_timestamp", as_of, hours=hours)).groupBy("insert_id", "source_table").agg(F.count("*").alias("n"))
    return ids.filter(F.col("n") > 1).groupBy("source_table").agg(F.count("insert_id").alias("duplicate_ids"), F.sum("n").alias("total_duplicate_rows"))


def _seconds(start: str, end: str) -> Column:
    """Whole seconds from start to end."""
    return F.floor((F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(1_000_000))


def ingestion_latency(df: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    rows = df.filter(since(df, "event_timestamp", as_of, hours=hours) & F.col("receive_timestamp").isNotNull())
    rows = rows.select("source_table", _seconds("event_timestamp", "receive_timestamp").alias("s"))
    return rows.groupBy("source_table").agg(
        F.count("*").alias("total_rows"),
        F.avg("s").alias("avg_latency_sec"),
        quantile("s", 0.50).alias("p50_latency_sec"),
        quantile("s", 0.95).alias("p95_latency_sec"),
        quantile("s", 0.99).alias("p99_latency_sec"),
    )


def dq_summary(df: DataFrame, as_of: str, hours: float = 24, duplicate_hours: float = 1) -> DataFrame:
    """How many tables or values fail each check.

    One pass per (source, severity) serves the first three checks, one per insert id the last; the few result rows are added
    up from one union, not cross-joined.
    """
    inside, no_time = since(df, "event_timestamp", as_of, hours=hours), F.col("event_timestamp").isNull()
    groups = df.filter(inside | no_time).groupBy("source_table", "severity").agg(
        count_if(no_time).alias("no_time"), count_if(inside).alias("n"), count_if(inside & (F.coalesce("service_name", F.lit("")) == "")).alias("no_service")
    )
    unknown = (F.col("n") > 0) & ~F.col("severity").isin(SEVERITIES)
    first = groups.agg(
        F.count_distinct(F.when(F.col("no_time") > 0, F.col("source_table"))).alias("tables_with_null_timestamps"),
        count_if(unknown).alias("invalid_severity_count"),
        F.count_distinct(F.when(F.col("no_service") > 0, F.col("source_table"))).alias("tables_with_missing_service"),
        F.lit(0).cast("bigint").alias("tables_with_duplicates"),
    )
    zero = F.lit(0).cast("bigint")
    last = duplicate_insert_ids(df, as_of, duplicate_hours).agg(
        *[zero.alias(c) for c in first.columns[:3]], F.count("*").alias("tables_with_duplicates")
    )
    one = first.unionByName(last).agg(*[F.sum(c).alias(c) for c in first.columns])
    clean = (F.col("tables_with_null_timestamps") == 0) & (F.col("invalid_severity_count") == 0)
    return one.select(F.lit("data_quality_summary").alias("check_type"), *first.columns, F.when(clean, "HEALTHY").otherwise("DEGRADED").alias("overall_status"))


# --- envelope rows ----------------------------------------------------------------------------------------------------


def schema_coverage(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    e = "universal_envelope"
    fields = {
        "has_event_id": "event_id",
        "has_event_ts": "event_ts",
        "has_service_name": "service.name",
        "has_trace_id": "trace.trace_id",
        "has_actor_user_id": "actor.user_id",
        "has_correlation_request_id": "correlation.request_id",
        "has_privacy_pii_risk": "privacy.pii_risk",
    }
    return df.filter(days_back("log_date", as_of, days)).groupBy("log_date").agg(
        F.count("*").alias("total_rows"), *[F.count(f"{e}.{path}").alias(name) for name, path in fields.items()]
    )


def null_rates(df: DataFrame, fields: tuple[str, ...] = ("log_id", "event_timestamp", "severity", "service_name", "message")) -> DataFrame:
    """One row per required field with its share of nulls (empty messages count); one scan for all of them."""

    def missing(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "") if c == "message" else F.col(c).isNull()

    one = df.agg(*[F.try_divide(count_if(missing(c)), F.count("*")).alias(c) for c in fields])
    return one.unpivot([], list(fields), "field", "null_rate")


def ingest_latency_daily(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    rows = df.filter(days_back("log_date", as_of, days) & F.col("etl_timestamp").isNotNull() & F.col("event_timestamp").isNotNull())
    rows = rows.select("log_date", _seconds("event_timestamp", "etl_timestamp").alias("s"))
    return rows.groupBy("log_date").agg(
        F.avg("s").alias("avg_latency_seconds"),
        quantile("s", 0.50).alias("p50_latency_seconds"),
        quantile("s", 0.95).alias("p95_latency_seconds"),
        F.max("s").alias("max_latency_seconds"),
    )


# --- marts ------------------------------------------------------------------------------------------------------------


def freshness(marts: dict[str, tuple[DataFrame, str]], as_of: str, days: int = 30) -> DataFrame:
    """Rows, latest day and age of each mart, given as name -> (rows, date column)."""
    parts = [
        df.filter(days_back(date, as_of, days)).agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"), F.max(date).alias("latest_date"))
        for name, (df, date) in marts.items()
    ]
    age = F.datediff(day(as_of), F.col("latest_date"))
    status = F.when(age <= 1, FRESH).when(age <= 7, STALE).otherwise(VERY_OLD)
    return _union([p.select("table_name", "row_count", "latest_date") for p in parts]).withColumns({"days_old": age, "freshness_status": status})


def partition_skew(marts: dict[str, tuple[DataFrame, str]], as_of: str, days: int = 7) -> DataFrame:
    """Spread of the rows per day of each mart."""
    parts = [
        df.filter(days_back(date, as_of, days)).groupBy(F.col(date).alias("partition_date")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, (df, date) in marts.items()
    ]
    spread = _union(parts).groupBy("table_name").agg(
        F.count("*").alias("partition_count"),
        F.min("n").alias("min_rows_per_partition"),
        F.max("n").alias("max_rows_per_partition"),
        F.avg("n").alias("avg_rows_per_partition"),
        F.stddev_samp("n").alias("stddev_rows"),
    )
    variation = F.try_divide(F.col("stddev_rows"), F.col("avg_rows_per_partition"))
    return spread.withColumn("skew_status", F.when(variation > 2.0, HIGH_SKEW).when(variation > 1.0, MODERATE_SKEW).otherwise(BALANCED))


def cluster_effectiveness(marts: dict[str, tuple[DataFrame, list[str]]], exact: bool = True) -> DataFrame:
    """Cardinality of up to three cluster keys and rows per key combination of each mart."""
    distinct = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, 0.01)
    parts = []
    for name, (df, keys) in marts.items():
        combo = F.concat(*[F.col(k).cast("string") for k in keys])
        cards = [distinct(F.col(k).cast("string")).alias(f"cluster_key_{i}_cardinality") for i, k in enumerate(keys, 1)]
        cards += [F.lit(1).cast("bigint").alias(f"cluster_key_{i}_cardinality") for i in range(len(keys) + 1, 4)]
        rows = F.try_divide(F.count("*"), F.nullif(distinct(combo), F.lit(0)))
        one = df.agg(F.count("*").alias("total_rows"), *cards, rows.alias("avg_rows_per_cluster_combo"))
        parts.append(one.select(F.lit(f"{name} ({','.join(keys)})").alias("table_cluster_config"), "*"))
    per_combo = F.col("avg_rows_per_cluster_combo")
    status = F.when(per_combo.between(100, 10000), GOOD_CLUSTERING).when(per_combo < 100, OVER_CLUSTERED).otherwise(UNDER_CLUSTERED)
    return _union(parts).withColumn("clustering_status", status)


def label_compliance(df: DataFrame, name: str, labels_json: Column) -> DataFrame:
    """Required labels per table, from a JSON array of {key, value}."""
    labels = df.select(name, F.explode(F.from_json(labels_json, "array<struct<key:string,value:string>>")).alias("label"))
    key = F.col("label.key")
    return labels.groupBy(name).agg(
        F.count("*").alias("total_labels"),
        *[count_if(key == k).alias(f"has_{k}_label") for k in REQUIRED_LABELS],
        F.when(count_if(key.isin(REQUIRED_LABELS)) >= len(REQUIRED_LABELS), LABELS_COMPLETE).otherwise(LABELS_MISSING).alias("label_compliance"),
    )


def trace_connectivity(per_system: DataFrame, cross: DataFrame) -> DataFrame:
    """One table of text metrics: each system, then how far traces reach across systems."""
    individual = per_system.select(
        F.lit("Individual Systems").alias("metric_type"),
        F.col("source_system").alias("metric_name"),
        F.col("total_events").cast("string").alias("value"),
        F.concat(
            F.lit("Traces: "), "unique_traces", F.lit(", Users: "), "unique_users", F.lit(", Error Rate: "),
            F.format_string("%.2f", F.floor(F.col("error_rate") * 10000 + 0.5) / 100), F.lit("%"),
        ).alias("details"),
    )
    multi = cross.agg(F.count("*").alias("n"), F.avg("systems_in_trace").alias("avg"), F.count_distinct("systems_list").alias("combos"))
    average = F.format_string("%.1f", F.floor(F.coalesce("avg", F.lit(0.0)) * 10 + 0.5) / 10)
    reach = F.explode(
        F.array(
            F.struct(F.lit("Multi-system traces").alias("metric_name"), F.col("n").cast("string").alias("value"), F.concat(F.lit("Avg systems per trace: "), average).alias("details")),
            F.struct(F.lit("System combinations").alias("metric_name"), F.col("combos").cast("string").alias("value"), F.lit("Unique system combinations found").alias("details")),
        )
    )
    crossing = multi.select(reach.alias("m")).select(F.lit("Cross-System Tracing").alias("metric_type"), "m.*")
    return individual.unionByName(crossing)


def integrity_checks(logs: DataFrame, assets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Log ids complete, enough traces, diverse assets, several projects."""
    l = logs.agg(F.count("*").alias("n"), F.count("log_id").alias("ids"), F.count("trace_id").alias("traces"))  # noqa: E741
    share = F.try_divide(F.col("traces"), F.col("n"))
    ids = F.when(F.col("n") == F.col("ids"), ALL_LOG_IDS).otherwise(F.concat(F.lit("❌ Missing log_ids: "), F.col("n") - F.col("ids")))
    low = F.concat(F.lit("⚠️ Low trace coverage: "), F.format_string("%.1f", F.floor(share * 1000 + 0.5) / 10), F.lit("%"))
    coverage = F.when(share >= 0.8, GOOD_TRACES).otherwise(low)
    log_rows = F.explode(
        F.array(
            F.struct(F.lit("fact_logs completeness").alias("check_name"), ids.alias("result"), F.concat("n", F.lit(" total rows")).alias("details")),
            F.struct(
                F.lit("fact_logs trace_id coverage").alias("check_name"),
                coverage.alias("result"),
                F.concat("traces", F.lit(" of "), "n", F.lit(" rows have trace_id")).alias("details"),
            ),
        )
    )
    kinds = F.count_distinct("asset_type")
    projects = F.count_distinct("project_id")
    return _union(
        [
            l.select(log_rows.alias("c")).select("c.*"),
            assets.agg(
                F.lit("enterprise staging data types").alias("check_name"),
                F.when(kinds >= 5, DIVERSE_ASSETS).otherwise(LIMITED_ASSETS).alias("result"),
                F.concat(kinds, F.lit(" asset types found")).alias("details"),
            ),
            jobs.agg(
                F.lit("finops data distribution").alias("check_name"),
                F.when(projects >= 1, MULTI_PROJECT).otherwise(SINGLE_PROJECT).alias("result"),
                F.concat(projects, F.lit(" projects in FinOps data")).alias("details"),
            ),
        ]
    )


def validation_summary(marts: dict[str, tuple[DataFrame, str, str]], as_of: str, days: int = 30) -> DataFrame:
    """Rows, entities and age per data domain, given as domain -> (rows, entity column, date column)."""
    parts = [
        df.filter(days_back(date, as_of, days)).agg(
            F.lit(name).alias("data_domain"), F.count("*").alias("total_rows"), F.count_distinct(entity).alias("unique_entities"), F.max(date).alias("latest_data")
        )
        for name, (df, entity, date) in marts.items()
    ]
    behind = F.datediff(day(as_of), F.col("latest_data"))
    status = (
        F.when((F.col("total_rows") > 0) & (behind <= 1), HEALTHY)
        .when((F.col("total_rows") > 0) & (behind <= 7), HEALTH_STALE)
        .when(F.col("total_rows") == 0, NO_DATA)
        .otherwise(VERY_STALE)
    )
    return _union(parts).withColumns({"days_behind": behind, "health_status": status})


def row_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts and an order-free content hash of two tables, and whether they agree."""

    def digest(df: DataFrame, side: str) -> DataFrame:
        # a decimal sum of the row hashes cannot overflow and does not depend on the order
        row = F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")
        return df.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("hash"))

    both = digest(a, "a").unionByName(digest(b, "b"))
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    one = both.agg(side("a", "n").alias("rows_a"), side("b", "n").alias("rows_b"), side("a", "hash").alias("hash_a"), side("b", "hash").alias("hash_b"))
    return one.withColumns({"counts_equal": F.col("rows_a") == F.col("rows_b"), "content_equal": F.col("hash_a").eqNullSafe(F.col("hash_b"))})
