"""Named queries: dimensions, bridges, facts and job life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions.timewin import EVENTS_AS_OF as AS_OF
from lumenlog.operators import dimensions as d
from lumenlog.plans.registry import query
from lumenlog.sources.io import keyed_upsert

AFTER = "2024-01-03"
TO = "DATE '2024-01-02'"


def merge_sql(first: str, second: str, key: str, attributes: list[str], changed: str, new_version: bool = True, closed: str = TO) -> str:
    """Closed and current versions after two loads; ``changed`` compares the rows a (old) and b (new)."""
    cols = ", ".join(f"a.{x}" for x in attributes)
    fresh = ", ".join(f"b.{x}" for x in attributes)
    out = f"""WITH a AS ({first}), b AS ({second})
        SELECT a.{key}, {cols}, a.active_from, CASE WHEN {changed} THEN {closed} END AS active_to, NOT ({changed}) AS is_current FROM a LEFT JOIN b ON a.{key} = b.{key}
        UNION ALL SELECT b.{key}, {fresh}, b.active_from, NULL, true FROM b WHERE {key} NOT IN (SELECT {key} FROM a)"""
    if new_version:
        out += f" UNION ALL SELECT b.{key}, {fresh}, b.active_from, NULL, true FROM a JOIN b ON a.{key} = b.{key} WHERE {changed}"
    return out


def both_loads(stage1, stage2, key: str, tracked: list[str], **options):
    dim = d.new_dimension(stage1, key, F.col("active_from"))
    return d.scd2_merge(dim, stage2, key, tracked, AFTER, **options)


def staged(c, snapshot: int):
    return c.dim_stage.filter(F.col("snapshot") == snapshot).select("member_id", "display_name", "manager_id", F.col("fetched").alias("active_from"))


def member_sql(n: int) -> str:
    return f"SELECT member_id, display_name, manager_id, fetched AS active_from FROM dim_stage WHERE snapshot = {n}"


KNOWN = "b.member_id IS NOT NULL AND "
SAFE = KNOWN + "(a.display_name IS DISTINCT FROM b.display_name OR a.manager_id IS DISTINCT FROM b.manager_id)"
STRICT = KNOWN + "(coalesce(a.display_name <> b.display_name, false) OR coalesce(a.manager_id <> b.manager_id, false))"


@query("scd2_member", merge_sql(member_sql(1), member_sql(2), "member_id", ["display_name", "manager_id"], SAFE, new_version=False))
def _(c):
    return both_loads(staged(c, 1), staged(c, 2), "member_id", ["display_name", "manager_id"], insert_new_version=False)


@query("scd2_member_strict", merge_sql(member_sql(1), member_sql(2), "member_id", ["display_name", "manager_id"], STRICT, new_version=False, closed="DATE '2024-01-03'"))
def _(c):
    return both_loads(staged(c, 1), staged(c, 2), "member_id", ["display_name", "manager_id"], insert_new_version=False, null_safe=False, close_same_day=True)


@query("scd2_member_two_step", merge_sql(member_sql(1), member_sql(2), "member_id", ["display_name", "manager_id"], SAFE))
def _(c):
    return both_loads(staged(c, 1), staged(c, 2), "member_id", ["display_name", "manager_id"])


@query("scd2_rerun", merge_sql(member_sql(1), member_sql(2), "member_id", ["display_name", "manager_id"], SAFE))
def _(c):
    once = both_loads(staged(c, 1), staged(c, 2), "member_id", ["display_name", "manager_id"])
    return d.scd2_merge(once, staged(c, 2), "member_id", ["display_name", "manager_id"], "2024-01-04")


ORG1 = "SELECT 'n-' || n_nationkey AS org_id, n_name AS org_name, 'r-' || n_regionkey AS parent_org_id, DATE '2024-01-01' AS active_from FROM nation WHERE n_nationkey <> 3"
ORG2 = "SELECT 'n-' || n_nationkey AS org_id, CASE WHEN n_regionkey = 1 THEN n_name || ' B' ELSE n_name END AS org_name, 'r-' || n_regionkey AS parent_org_id, DATE '2024-01-02' AS active_from FROM nation"


@query("scd2_org", merge_sql(ORG1, ORG2, "org_id", ["org_name", "parent_org_id"], "b.org_id IS NOT NULL AND (a.org_name IS DISTINCT FROM b.org_name OR a.parent_org_id IS DISTINCT FROM b.parent_org_id)", new_version=False))
def _(c):
    return both_loads(c.sql(ORG1), c.sql(ORG2), "org_id", ["org_name", "parent_org_id"], insert_new_version=False)


PROJECT1 = "SELECT s_name AS project_id, 'name ' || s_suppkey AS project_name, 'ACTIVE' AS lifecycle_state, DATE '2024-01-01' AS active_from FROM supplier WHERE s_nationkey <> 5"
PROJECT2 = "SELECT s_name AS project_id, 'name ' || s_suppkey AS project_name, CASE WHEN s_acctbal < 0 THEN 'DELETED' ELSE 'ACTIVE' END AS lifecycle_state, DATE '2024-01-02' AS active_from FROM supplier"
PROJECT_CHANGED = "b.project_id IS NOT NULL AND (a.project_name IS DISTINCT FROM b.project_name OR a.lifecycle_state IS DISTINCT FROM b.lifecycle_state)"


@query("scd2_project", merge_sql(PROJECT1, PROJECT2, "project_id", ["project_name", "lifecycle_state"], PROJECT_CHANGED, new_version=False))
def _(c):
    return both_loads(c.sql(PROJECT1), c.sql(PROJECT2), "project_id", ["project_name", "lifecycle_state"], insert_new_version=False)


@query("scd2_project_two_step", merge_sql(PROJECT1, PROJECT2, "project_id", ["project_name", "lifecycle_state"], PROJECT_CHANGED))
def _(c):
    return both_loads(c.sql(PROJECT1), c.sql(PROJECT2), "project_id", ["project_name", "lifecycle_state"])


SERVICE = "SELECT DISTINCT p_brand AS service_id, p_brand AS service_name, DATE '2024-01-0{n}' AS active_from FROM part{where}"


@query("scd2_service", merge_sql(SERVICE.format(n=1, where=" WHERE p_brand <> 'Brand#7'"), SERVICE.format(n=2, where=""), "service_id", ["service_name"], "b.service_id IS NOT NULL AND a.service_name IS DISTINCT FROM b.service_name", new_version=False))
def _(c):
    first, second = c.sql(SERVICE.format(n=1, where=" WHERE p_brand <> 'Brand#7'")), c.sql(SERVICE.format(n=2, where=""))
    return both_loads(first, second, "service_id", ["service_name"], insert_new_version=False)


@query("fact_policy", "SELECT policy_snapshot_date, project_id, resource, member, role, condition, 'asset_inventory' AS origin, 'org_model' AS source_system, 'asset_export' AS ingestion_method FROM policies WHERE member IS NOT NULL AND project_id IS NOT NULL")
def _(c):
    return d.fact_policy(c.assets)


@query(
    "fact_usage",
    """SELECT log_date AS usage_date, service_name AS service_id, count(*) FILTER (WHERE is_request) AS request_count, count(*) FILTER (WHERE is_error) AS error_count,
       count(*) FILTER (WHERE is_request AND NOT is_error) AS success_count, quantile_disc(http_latency_ms, 0.5) AS latency_p50_ms, quantile_disc(http_latency_ms, 0.95) AS latency_p95_ms
       FROM logs_rich WHERE log_date >= DATE '2024-01-31' - 31 GROUP BY ALL""",
)
def _(c):
    return d.fact_usage(c.logs_rich, AS_OF, 31)


@query(
    "register_stream",
    """SELECT stream_id, count(*) AS row_count, max(event_timestamp) AS updated_at FROM logs GROUP BY 1 UNION ALL SELECT 'legacy.syslog', 0, TIMESTAMP '2023-01-01 00:00:00' FROM region WHERE r_regionkey = 0""",
)
def _(c):
    old = c.logs.filter(F.col("log_date") < "2024-01-10").groupBy("stream_id").agg(F.count("*").alias("row_count"), F.max("event_timestamp").alias("updated_at"))
    extra = c.region.filter("r_regionkey = 0").selectExpr("'legacy.syslog' AS stream_id", "0L AS row_count", "TIMESTAMP_NTZ '2023-01-01 00:00:00' AS updated_at")
    new = c.logs.groupBy("stream_id").agg(F.count("*").alias("row_count"), F.max("event_timestamp").alias("updated_at"))
    return keyed_upsert(old.unionByName(extra), new, "stream_id", "updated_at")


BATCHES = "(SELECT stream_id, log_date, count(*) AS rows, max(CAST(log_id AS BIGINT)) AS last_offset, max(event_timestamp) AS synced_at FROM logs GROUP BY stream_id, log_date) AS b"


def batches(c):
    return c.logs.groupBy("stream_id", "log_date").agg(F.count("*").alias("rows"), F.max(F.col("log_id").cast("bigint")).alias("last_offset"), F.max("event_timestamp").alias("synced_at"))


@query("sync_state", f"SELECT stream_id, max(last_offset) AS last_sync_offset, CAST(sum(rows) AS BIGINT) AS total_records_synced, max(synced_at) AS last_sync_at FROM {BATCHES} GROUP BY 1")
def _(c):
    return d.sync_state(batches(c))


@query(
    "pending_streams",
    """WITH n AS (SELECT stream_id, count(*) AS row_count FROM logs GROUP BY 1), s AS (SELECT stream_id, count(*) AS done FROM logs WHERE log_date < DATE '2024-01-20' AND stream_id <> 'logs_v1.view' GROUP BY 1)
       SELECT n.stream_id, row_count, coalesce(done, 0) AS last_sync_offset, row_count - coalesce(done, 0) AS pending FROM n LEFT JOIN s ON n.stream_id = s.stream_id WHERE coalesce(done, 0) < row_count""",
)
def _(c):
    counts = c.logs.groupBy("stream_id").agg(F.count("*").alias("row_count"))
    synced = c.logs.filter((F.col("log_date") < "2024-01-20") & (F.col("stream_id") != "logs_v1.view")).groupBy("stream_id").agg(F.count("*").alias("last_sync_offset"))
    return d.pending_streams(counts, synced)


LINKS = "(SELECT CAST(c_custkey % 30 AS STRING) AS member, 'svc-' || CAST(min(c_nationkey) AS STRING) AS service_id, DATE '1990-01-01' AS active_from, DATE '1998-06-30' AS active_to FROM customer GROUP BY 1 UNION ALL SELECT CAST(c_custkey % 30 AS STRING), 'svc-' || CAST(max(c_nationkey) AS STRING), DATE '1998-07-01', NULL FROM customer GROUP BY 1) AS l"


@query(
    "bridges",
    f"""SELECT o_orderkey, CAST(o_custkey % 30 AS VARCHAR) AS member, CAST(o_orderdate AS DATE) AS on_day, service_id FROM orders LEFT JOIN {LINKS}
        ON CAST(o_custkey % 30 AS VARCHAR) = member AND CAST(o_orderdate AS DATE) BETWEEN active_from AND coalesce(active_to, DATE '9999-12-31')""",
)
def _(c):
    links = c.sql(f"SELECT * FROM {LINKS}")
    facts = c.orders.select("o_orderkey", (F.col("o_custkey") % 30).cast("string").alias("member"), F.to_date("o_orderdate").alias("on_day"))
    return d.resolve_at(facts, links, "member", "on_day").select("o_orderkey", "member", "on_day", "service_id")


@query(
    "job_lifecycle",
    """SELECT job_id, CASE WHEN status = 'RUNNING' THEN 'RUNNING' ELSE status END AS status, started_at, CASE WHEN status <> 'RUNNING' THEN started_at + INTERVAL '5' MINUTE END AS completed_at,
       CASE WHEN status <> 'RUNNING' THEN total_loaded ELSE 0 END AS records_processed FROM etl_jobs""",
)
def _(c):
    begun = c.etl_jobs.select("job_id", F.lit("RUNNING").alias("status"), F.col("started_at").alias("at"), F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("records_processed"))
    ended = c.etl_jobs.filter("status <> 'RUNNING'").select("job_id", "status", (F.col("started_at") + F.expr("INTERVAL 5 MINUTES")).alias("at"), F.lit(1).alias("step"), F.col("total_loaded").alias("records_processed"))
    return d.latest_job_status(begun.unionByName(ended))
