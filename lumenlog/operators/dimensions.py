"""Slowly changing dimensions, bridges, usage and policy facts, stream registry and job life cycle.

Plain files have no MERGE; a merge here is one full outer join of the current rows with the stage, and its result is the
whole new table (write it to a new version or overwrite the touched partitions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.columns import count_if, differs
from lumenlog.functions.stats import quantile
from lumenlog.functions.timewin import day, days_back


def new_dimension(stage: DataFrame, key: str, active_from: Column) -> DataFrame:
    """First load: every stage row becomes a current version."""
    return stage.withColumns(
        {"active_from": active_from, "active_to": F.lit(None).cast("date"), "is_current": F.lit(True)}
    ).filter(F.col(key).isNotNull())


def scd2_merge(
    dim: DataFrame,
    stage: DataFrame,
    key: str,
    tracked: list[str],
    as_of: str,
    insert_new_version: bool = True,
    null_safe: bool = True,
    close_same_day: bool = False,
) -> DataFrame:
    """Close current versions whose tracked columns changed; insert unknown keys and, by default, the new versions.

    ``insert_new_version=False`` only closes, so the new version appears on the next run. ``null_safe=False`` compares with
    ``!=``, where a null on either side is no change. ``close_same_day`` ends a version on ``as_of`` instead of the day before.
    """
    columns = dim.columns
    attributes = [c for c in columns if c not in (key, "active_from", "active_to", "is_current")]
    s = stage.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in attributes], F.col("active_from").alias("new_active_from")).distinct()
    current, history = dim.filter(F.col("is_current")), dim.filter(~F.col("is_current"))
    both = current.withColumn("_known", F.lit(True)).join(s.withColumn("_staged", F.lit(True)), key, "full_outer")

    known, staged = F.col("_known").isNotNull(), F.col("_staged").isNotNull()
    change = F.lit(False)
    for c in tracked:
        one = differs(c, f"new_{c}") if null_safe else F.coalesce(F.col(c) != F.col(f"new_{c}"), F.lit(False))
        change = change | one
    changed = known & staged & change
    closed_on = day(as_of) if close_same_day else F.date_sub(day(as_of), 1)
    old = F.struct(
        *[F.col(c) for c in (key, *attributes)],
        F.col("active_from"),
        F.when(changed, closed_on).otherwise(F.col("active_to")).alias("active_to"),
        (~changed).alias("is_current"),
    )
    fresh = F.struct(
        F.col(key),
        *[F.col(f"new_{c}").alias(c) for c in attributes],
        F.coalesce("new_active_from", day(as_of)).alias("active_from"),
        F.lit(None).cast("date").alias("active_to"),
        F.lit(True).alias("is_current"),
    )
    adds = staged & (~known | changed) if insert_new_version else staged & ~known
    versions = F.filter(F.array(F.when(known, old), F.when(adds, fresh)), lambda v: v.isNotNull())
    merged = both.select(F.explode(versions).alias("v")).select("v.*")
    return history.select(*columns).unionByName(merged.select(*columns))


def valid_at(links: DataFrame, date: Column) -> Column:
    """Whether a row of an effective-dated table is in force on ``date``."""
    return date.between(F.col("active_from"), F.coalesce("active_to", F.lit("9999-12-31").cast("date")))


def resolve_at(facts: DataFrame, links: DataFrame, key: str, date: str) -> DataFrame:
    """Facts with the link that was in force on the fact's day.

    An equi-join on the key with the date range as a residual; a key has few versions, so rows hardly multiply. A key with
    very many facts is split by adaptive skew handling, as the range test needs nothing but the matched pair.
    """
    hit = valid_at(links, facts[date])
    return facts.join(links, (facts[key] == links[key]) & hit, "left").drop(links[key])


def fact_policy(assets: DataFrame) -> DataFrame:
    """One row per member of every binding of each asset's access policy, with role and condition."""
    bindings = F.from_json(F.get_json_object("payload", "$.iamPolicy.bindings"), "array<struct<role:string,members:array<string>,condition:string>>")
    rows = assets.select(
        F.to_date("fetched_at").alias("policy_snapshot_date"),
        F.get_json_object("payload", "$.project").alias("project_id"),
        F.get_json_object("payload", "$.name").alias("resource"),
        F.explode(bindings).alias("b"),
    ).withColumn("member", F.explode("b.members"))
    return rows.select(
        "policy_snapshot_date",
        "project_id",
        "resource",
        "member",
        F.col("b.role").alias("role"),
        F.col("b.condition").alias("condition"),
        F.lit("asset_inventory").alias("origin"),
        F.lit("org_model").alias("source_system"),
        F.lit("asset_export").alias("ingestion_method"),
    ).filter(F.col("member").isNotNull() & F.col("project_id").isNotNull())


def fact_usage(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    request, error = F.col("is_request"), F.col("is_error")
    return logs.filter(days_back("log_date", as_of, days)).groupBy(F.col("log_date").alias("usage_date"), F.col("service_name").alias("service_id")).agg(
        count_if(request).alias("request_count"),
        count_if(error).alias("error_count"),
        count_if(request & ~error).alias("success_count"),
        quantile("http_latency_ms", 0.50).alias("latency_p50_ms"),
        quantile("http_latency_ms", 0.95).alias("latency_p95_ms"),
    )


# --- streams and jobs -------------------------------------------------------------------------------------------------


def sync_state(batches: DataFrame) -> DataFrame:
    """Last offset, last sync and cumulative rows per stream out of the batch log."""
    return batches.groupBy("stream_id").agg(
        F.max("last_offset").alias("last_sync_offset"), F.sum("rows").alias("total_records_synced"), F.max("synced_at").alias("last_sync_at")
    )


def pending_streams(counts: DataFrame, state: DataFrame) -> DataFrame:
    """Streams that hold more rows than have been synced."""
    both = counts.join(state, "stream_id", "left").withColumn("last_sync_offset", F.coalesce("last_sync_offset", F.lit(0)))
    return both.filter(F.col("last_sync_offset") < F.col("row_count")).select(
        "stream_id", "row_count", "last_sync_offset", (F.col("row_count") - F.col("last_sync_offset")).alias("pending")
    )


def latest_job_status(events: DataFrame) -> DataFrame:
    """Latest state of each job out of its append-only status rows."""
    order = F.struct("at", "step")
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.min("at").alias("started_at"),
        F.max(F.when(F.col("status") != "RUNNING", F.col("at"))).alias("completed_at"),
        F.max("records_processed").alias("records_processed"),
    )
