"""Named queries: billing, pricing, commitments and job cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.adapters import ORACLE_VIEWS
from lumenlog.contracts import SERVICE_NAMES
from lumenlog.functions.timewin import BILLING_AS_OF as AS_OF
from lumenlog.operators import finops as f
from lumenlog.plans.registry import query, r, rounded
from lumenlog.session import scratch_path

ALL = 4000  # days: the whole data set


def billing_nested(c):
    b = c.billing
    return b.select(
        "billing_account_id",
        F.struct(F.col("service_id").alias("id"), F.col("service_name").alias("description")).alias("service"),
        F.struct(F.col("sku_id").alias("id"), F.col("sku_description").alias("description")).alias("sku"),
        F.struct(F.col("project_id").alias("id"), F.concat(F.lit("name "), "project_id").alias("name")).alias("project"),
        "usage_date",
        "usage_start_time",
        "usage_end_time",
        "cost",
        "currency",
        F.struct(F.col("usage_amount").alias("amount"), F.col("usage_unit").alias("unit")).alias("usage"),
        F.struct("location", "country", "region").alias("location"),
        F.array(F.struct(F.lit("env").alias("key"), F.lit("prod").alias("value")), F.struct(F.lit("statement_type").alias("key"), F.col("sku_id").alias("value"))).alias("labels"),
        "l_orderkey",
        "l_linenumber",
    )


def detailed_jobs(c):
    """Jobs with labels, a query hash and referenced tables."""
    return c.jobs.withColumns(
        {
            "labels": F.create_map(F.lit("team"), F.col("project_id")),
            "query_hash": F.md5("job_id"),
            "referenced_tables": F.array(F.struct(F.col("project_id").alias("dataset_id"), F.concat(F.lit("t_"), "job_type").alias("table_id"))),
        }
    )


@query(
    "materialize_jobs",
    """SELECT CAST(creation_time AS DATE) AS dt, job_id, project_id, user_name AS user_email, '{"team":"' || project_id || '"}' AS labels, total_bytes_processed, total_slot_ms, cache_hit,
       statement_type, md5(job_id) AS query_hash, 't_' || job_type AS referenced_tables FROM jobs WHERE CAST(creation_time AS DATE) = DATE '1998-10-03'""",
)
def _(c):
    rows = f.materialize_jobs(detailed_jobs(c), "1998-10-03")
    return rows.withColumn("referenced_tables", F.array_join("referenced_tables", ","))


COST = "coalesce(CAST(total_bytes_billed AS DOUBLE) / power(1024, 4) * 6.25, 0.0)"
JOBS = "FROM jobs WHERE dt >= DATE '2001-11-05' - 4000 AND job_type IN ('QUERY', 'LOAD', 'EXPORT', 'COPY') AND state = 'DONE'"
ORACLE_VIEWS["job_costs"] = f"SELECT dt, project_id, job_id, {COST} AS cost_usd, total_bytes_processed, coalesce(statement_type, 'QUERY') AS statement_type, total_slot_ms {JOBS}"


@query("job_cost", f"SELECT dt, project_id, statement_type, {r('cost_usd', 6)} AS cost_usd, job_id, total_bytes_processed, total_slot_ms FROM job_costs")
def _(c):
    rows = f.job_cost(c.jobs, AS_OF, ALL)
    return rounded(rows.select("dt", "project_id", "statement_type", "cost_usd", "job_id", "total_bytes_processed", "total_slot_ms"), "cost_usd", digits=6)


EXPORT = "usage_date AS dt, project_id, cost AS cost_usd, currency, service_name, sku_description, usage_start_time, usage_end_time, CAST(NULL AS VARCHAR) AS job_id, 'billing_export' AS source_system"


@query("export_to_jobs", f"SELECT {EXPORT}, sku_id AS statement_type FROM billing WHERE cost > 0 AND service_name = 'BigQuery'")
def _(c):
    return f.export_to_jobs(billing_nested(c), AS_OF, ALL)


@query("export_to_jobs_all", f"SELECT {EXPORT}, service_name AS statement_type FROM billing WHERE cost > 0")
def _(c):
    return f.export_to_jobs(billing_nested(c), AS_OF, ALL, service=None)


@query("jobs_clustered", "SELECT * FROM jobs WHERE dt IS NOT NULL")
def _(c):
    from lumenlog.session import scratch_path
    from lumenlog.sources.io import write_clustered

    path = scratch_path(c.spark, "jobs")
    # months as partitions: thousands of single-day folders would be too small to read well
    write_clustered(c.jobs.filter(F.col("dt").isNotNull()).withColumn("month", F.date_format("dt", "yyyy-MM")), path, "month", ["project_id", "statement_type", "cache_hit"])
    return c.spark.read.parquet(path).drop("month")


@query(
    "daily_job_cost",
    f"SELECT dt, count(*) AS jobs, {r('sum(cost_usd)')} AS daily_cost, {r('sum(total_bytes_processed) / 1e9')} AS gb_processed FROM job_costs GROUP BY dt ORDER BY dt DESC LIMIT 7",
)
def _(c):
    return rounded(f.daily_job_cost(f.job_cost(c.jobs, AS_OF, ALL)), "daily_cost", "gb_processed")


FLAT = """billing_account_id, service_id, service_name, sku_id, sku_description, project_id, usage_date, usage_start_time, usage_end_time, cost, currency, usage_amount, usage_unit,
    location, country, region"""


@query("flatten_billing", f"""SELECT {FLAT}, 'name ' || project_id AS project_name, 'v3' AS schema_version, '[{{"key":"env","value":"prod"}},{{"key":"statement_type","value":"' || sku_id || '"}}]' AS labels FROM billing""")
def _(c):
    names = [x.strip() for x in FLAT.replace("\n", " ").split(",")]
    return f.flatten_billing(billing_nested(c), AS_OF, ALL).select(*names, "project_name", "schema_version", "labels")


STORED = "(usage_date < DATE '1999-01-01' AND billing_account_id <> 'acct-2')"


@query("ingest_billing", f"SELECT {FLAT} FROM billing WHERE usage_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND (billing_account_id, usage_date) NOT IN (SELECT (billing_account_id, usage_date) FROM billing WHERE {STORED})")
def _(c):
    target = c.billing.filter((F.col("usage_date") < "1999-01-01") & (F.col("billing_account_id") != "acct-2"))
    names = [x.strip() for x in FLAT.replace("\n", " ").split(",")]
    return f.ingest_billing(c.billing.select(*names), target, "1995-01-01", "2001-12-31").select(*names)


@query("ingest_billing_by_day", f"SELECT {FLAT} FROM billing WHERE usage_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND usage_date NOT IN (SELECT usage_date FROM billing WHERE {STORED})")
def _(c):
    target = c.billing.filter((F.col("usage_date") < "1999-01-01") & (F.col("billing_account_id") != "acct-2"))
    names = [x.strip() for x in FLAT.replace("\n", " ").split(",")]
    return f.ingest_billing(c.billing.select(*names), target, "1995-01-01", "2001-12-31", by_account=False).select(*names)


BUCKET = "CASE WHEN cost < 0.01 THEN 'micro' WHEN cost < 1.0 THEN 'small' WHEN cost < 10.0 THEN 'medium' WHEN cost < 100.0 THEN 'large' ELSE 'xlarge' END"


@query("cost_bucket", f"SELECT l_orderkey, l_linenumber, cost, {BUCKET} AS cost_bucket FROM billing")
def _(c):
    return c.billing.select("l_orderkey", "l_linenumber", "cost", f.cost_bucket().alias("cost_bucket"))


def archive_sql(where: str) -> str:
    return f"""SELECT CAST(year(usage_date) AS INTEGER) AS archive_year, CAST(month(usage_date) AS INTEGER) AS archive_month, {', '.join(f.ARCHIVE_KEYS)}, {BUCKET} AS cost_bucket,
        count(*) AS record_count, {r('sum(cost)', 8)} AS total_cost, {r('avg(cost)', 9)} AS avg_cost, max(cost) AS max_cost, sum(usage_amount) AS total_usage_amount,
        min(usage_date) AS period_start, max(usage_date) AS period_end FROM billing WHERE {where} GROUP BY ALL"""


@query("archive_rollup", archive_sql("true"))
def _(c):
    return rounded(rounded(f.archive_rollup(c.billing), "total_cost", digits=8), "avg_cost", digits=9)


@query("archive_incremental", archive_sql("usage_date < DATE '2001-11-05' - 180"))
def _(c):
    """Three runs: early lines of early days, then everything that is old enough, late lines of archived days among it, then nothing new."""
    path = scratch_path(c.spark, "archive")
    lines = c.billing.withColumn("batch_id", F.when(F.col("l_linenumber") > 3, "late").otherwise("first"))
    f.archive_incremental(lines.filter("batch_id = 'first'"), path, 0, "1996-07-13")
    for run in (1, 1, 2):  # a repeated run, too
        f.archive_incremental(lines, path, run, AS_OF)
    return rounded(rounded(f.archived(c.spark, path), "total_cost", digits=8), "avg_cost", digits=9)


@query("archive_workforce", f"SELECT attribution_date, member_id, project_id, {r('total_attributed_cost', 6)} AS total_attributed_cost FROM workforce WHERE attribution_date < DATE '2001-11-05' - 180 AND attribution_date >= DATE '1997-01-01'")
def _(c):
    archive = c.workforce.filter(F.col("attribution_date") < "1997-01-01")
    added = f.archive_workforce(c.workforce, archive, AS_OF)
    again = f.archive_workforce(c.workforce, archive.unionByName(added), AS_OF)
    return rounded(added.unionByName(again).select("attribution_date", "member_id", "project_id", "total_attributed_cost"), "total_attributed_cost", digits=6)


@query(
    "bq_cost_detail",
    f"""WITH j AS (SELECT CAST(creation_time AS DATE) AS d, project_id AS p, count(*) AS job_count, CAST(sum(total_bytes_billed) AS BIGINT) AS total_bytes_billed, CAST(sum(total_slot_ms) AS BIGINT) AS total_slot_ms,
        count(*) FILTER (WHERE cache_hit) AS cache_hits FROM jobs GROUP BY ALL)
        SELECT usage_date, project_id, cost, usage_amount, sku_description, l_orderkey, l_linenumber, job_count, total_bytes_billed, total_slot_ms, cache_hits,
        {r('CASE WHEN total_bytes_billed > 0 THEN cost / (total_bytes_billed / power(1024, 4)) END')} AS cost_per_tb,
        {r('CASE WHEN total_slot_ms > 0 THEN cost / (total_slot_ms / 1000) END', 6)} AS cost_per_slot_second
        FROM billing LEFT JOIN j ON project_id = p AND usage_date = d WHERE service_id = 'id-0'""",
)
def _(c):
    return rounded(rounded(f.bq_cost_detail(c.billing, c.jobs, "id-0"), "cost_per_tb"), "cost_per_slot_second", digits=6)


@query(
    "bq_cost_detail_by_job",
    f"""SELECT usage_date, billing.project_id, cost, usage_amount, sku_description, l_orderkey, l_linenumber, job_id, user_name, statement_type, total_bytes_billed, total_slot_ms, cache_hit,
        {r('CASE WHEN total_bytes_billed > 0 THEN cost / (total_bytes_billed / power(1024, 4)) END')} AS cost_per_tb, {r('CASE WHEN total_slot_ms > 0 THEN cost / (total_slot_ms / 1000) END', 6)} AS cost_per_slot_second
        FROM billing LEFT JOIN jobs ON billing.project_id = jobs.project_id AND usage_date = CAST(creation_time AS DATE) WHERE service_id = 'id-0' AND usage_date BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'""",
)
def _(c):
    month = F.col("usage_date").between("1995-03-01", "1995-03-31")
    jobs = c.jobs.filter(F.to_date("creation_time").between("1995-03-01", "1995-03-31"))
    return rounded(rounded(f.bq_cost_detail(c.billing.filter(month), jobs, "id-0", per_job=True), "cost_per_tb"), "cost_per_slot_second", digits=6)


def like(*pairs: tuple[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(sku_description, '{w}') THEN '{v}'" for w, v in pairs) + f" ELSE '{default}' END"


@query(
    "compute_cost_detail",
    f"""SELECT usage_date, project_id, cost, usage_amount, usage_unit, sku_description, nullif(regexp_extract(sku_description, '(n1-|n2-|e2-|c2-|m1-|f1-|g1-)[a-z0-9-]+', 1), '') AS machine_type,
        nullif(regexp_extract(sku_description, 'running in (.+)', 1), '') AS zone, {like(('Preemptible', 'preemptible'), ('Spot', 'spot'), default='standard')} AS instance_type,
        {like(('Core', 'cpu'), ('Ram', 'memory'), ('Disk', 'storage'), ('GPU', 'gpu'), default='other')} AS resource_type, location FROM billing WHERE service_name = 'Compute Engine'""",
)
def _(c):
    return f.compute_cost_detail(c.billing)


@query(
    "storage_cost_detail",
    f"""SELECT usage_date, project_id, cost, usage_amount, usage_unit, sku_description, {like(('Standard', 'standard'), ('Nearline', 'nearline'), ('Coldline', 'coldline'), ('Archive', 'archive'), default='unknown')} AS storage_class,
        {like(('Storage', 'storage'), ('Download', 'network'), ('Egress', 'network'), ('Operation', 'operations'), default='other')} AS cost_type, location, region FROM billing WHERE service_name = 'Cloud Storage'""",
)
def _(c):
    return f.storage_cost_detail(c.billing)


ORACLE_VIEWS["dashboard"] = """
SELECT coalesce(w.members, 0) AS who_active_members, d.service_name AS what_service, array_to_string(list_slice(d.skus, 1, 5), ', ') AS what_resources, d.project_id AS where_project,
       d.billing_account_id AS where_billing_account, d.usage_date AS when_date, CAST(dayofweek(d.usage_date) + 1 AS INTEGER) AS when_day_of_week, 'operational' AS why_purpose,
       d.daily_cost AS how_much_cost, coalesce(w.attributed, 0) AS how_much_attributed, d.daily_cost - coalesce(w.attributed, 0) AS how_much_unattributed, d.line_items AS how_many_line_items,
       CASE WHEN d.daily_cost > 0 AND coalesce(w.attributed, 0) > 0 THEN w.attributed / d.daily_cost ELSE 0 END AS attribution_efficiency,
       CAST(date_trunc('week', d.usage_date + 1) AS DATE) - 1 AS week_start, CAST(date_trunc('month', d.usage_date) AS DATE) AS month_start
FROM (SELECT usage_date, billing_account_id, service_name, project_id, sum(cost) AS daily_cost, count(*) AS line_items, list(DISTINCT sku_description ORDER BY sku_description) AS skus FROM billing GROUP BY ALL) AS d
LEFT JOIN (SELECT attribution_date, project_id, sum(total_attributed_cost) AS attributed, count(DISTINCT member_id) AS members FROM workforce GROUP BY ALL) AS w
ON d.usage_date = w.attribution_date AND d.project_id = w.project_id
"""
MONEY = ["how_much_cost", "how_much_attributed", "how_much_unattributed"]
EFFICIENCY = r("attribution_efficiency") + " AS attribution_efficiency"
# eight digits: the sums are exact to seven, so no rounding tie can occur
DASH = "SELECT * REPLACE (" + ", ".join(f"{r(m, 8)} AS {m}" for m in MONEY) + f", {EFFICIENCY}) FROM dashboard"


def money(df):
    return rounded(rounded(df, *MONEY, digits=8), "attribution_efficiency")


@query("cost_dashboard", DASH)
def _(c):
    return money(f.cost_dashboard(c.billing, c.workforce, AS_OF, ALL))


@query("top_cost_dashboard", DASH + " WHERE when_date >= DATE '2001-11-05' - 30 ORDER BY how_much_cost DESC, when_date, what_service, where_project, where_billing_account LIMIT 20")
def _(c):
    return money(f.top_cost_dashboard(f.cost_dashboard(c.billing, c.workforce, AS_OF), AS_OF, days=30))


@query(
    "cost_recommendations",
    f"""WITH t AS (SELECT service_name, project_id, avg(cost) AS a, stddev_samp(cost) AS v, count(DISTINCT usage_date) AS active_days FROM billing GROUP BY ALL)
        SELECT service_name, project_id, {r('a')} AS avg_daily_cost, {r('a * 30')} AS projected_monthly_cost, {r('v')} AS cost_volatility, active_days,
        CASE WHEN service_name = 'Compute Engine' AND a > 10 THEN 'Consider preemptible instances for non-critical workloads'
             WHEN service_name = 'Cloud Storage' AND v > a * 0.5 THEN 'Review storage class optimization for lifecycle management'
             WHEN service_name = 'BigQuery' AND a > 5 THEN 'Implement slot reservations for predictable workloads' ELSE 'Monitor usage patterns' END AS optimization_recommendation,
        CASE WHEN a > 20 THEN 'high' WHEN a > 5 THEN 'medium' ELSE 'low' END AS cost_priority FROM t WHERE a > 0.10""",
)
def _(c):
    return rounded(f.cost_recommendations(c.billing, AS_OF, ALL), "avg_daily_cost", "projected_monthly_cost", "cost_volatility")


@query(
    "workforce_attribution",
    f"""WITH o AS (SELECT attribution_date AS d, member_id, project_id AS p, sum(total_attributed_cost) AS direct_cost FROM workforce GROUP BY ALL),
        s AS (SELECT usage_date AS d, project_id AS p, sum(cost) AS shared FROM billing GROUP BY ALL), t AS (SELECT d, p, sum(direct_cost) AS total FROM o GROUP BY ALL)
        SELECT o.d AS attribution_date, member_id, o.p AS project_id, {r('direct_cost')} AS direct_cost, {r('coalesce(direct_cost * shared / total, 0)')} AS allocated_cost,
        {r('direct_cost + coalesce(direct_cost * shared / total, 0)')} AS total_attributed_cost FROM o JOIN t ON o.d = t.d AND o.p = t.p LEFT JOIN s ON o.d = s.d AND o.p = s.p""",
)
def _(c):
    return rounded(f.workforce_attribution(c.workforce, c.billing), "direct_cost", "allocated_cost", "total_attributed_cost")


ORGS = "(SELECT 'n-' || n_nationkey AS org_id, n_name AS org_name, 'r-' || n_regionkey AS parent_org_id FROM nation UNION ALL SELECT 'r-' || r_regionkey, r_name, 'top' FROM region UNION ALL SELECT 'top', 'all', NULL FROM region WHERE r_regionkey = 0) AS o"


@query(
    "org_hierarchy_costs",
    f"""WITH RECURSIVE k AS (SELECT 'n-' || s_nationkey AS org_id, sum(l_extendedprice * (1 - l_discount) / 1000) AS own FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
        t AS (SELECT o.org_id, org_name, parent_org_id, coalesce(own, 0) AS own_cost FROM {ORGS} LEFT JOIN k ON o.org_id = k.org_id),
        up AS (SELECT org_id, parent_org_id AS above, own_cost FROM t WHERE parent_org_id IS NOT NULL UNION ALL SELECT up.org_id, t.parent_org_id, up.own_cost FROM up JOIN t ON t.org_id = up.above WHERE t.parent_org_id IS NOT NULL),
        ch AS (SELECT above AS org_id, sum(own_cost) AS children, (SELECT count(*) FROM t WHERE parent_org_id = above) AS child_count FROM up GROUP BY 1)
        SELECT t.org_id, org_name, parent_org_id, {r('own_cost', 2)} AS own_cost, coalesce(child_count, 0) AS child_count, {r('own_cost + coalesce(children, 0)', 2)} AS total_cost FROM t LEFT JOIN ch ON t.org_id = ch.org_id""",
)
def _(c):
    lines = c.lineitem.join(c.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("n-"), "s_nationkey").alias("org_id"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("cost")
    )
    leaf = c.nation.select(F.concat(F.lit("n-"), "n_nationkey").alias("org_id"), F.col("n_name").alias("org_name"), F.concat(F.lit("r-"), "n_regionkey").alias("parent_org_id"))
    root = c.region.select(F.concat(F.lit("r-"), "r_regionkey").alias("org_id"), F.col("r_name").alias("org_name"), F.lit("top").alias("parent_org_id"))
    top = c.region.filter("r_regionkey = 0").select(F.lit("top").alias("org_id"), F.lit("all").alias("org_name"), F.lit(None).cast("string").alias("parent_org_id"))
    return rounded(f.org_hierarchy_costs(lines, leaf.unionByName(root).unionByName(top)), "own_cost", "total_cost", digits=2)


ORACLE_VIEWS["prices"] = """
SELECT service_id, sku_id, pricing_location, currency_code, arg_max(units, (effective_time, p_partkey)) AS units, arg_max(nanos, (effective_time, p_partkey)) AS nanos,
       max(effective_time) AS latest_price_update, count(*) AS pricing_tiers_count, CAST(arg_max(units, (effective_time, p_partkey)) AS DOUBLE) + arg_max(nanos, (effective_time, p_partkey)) / 1e9 AS price
FROM pricing GROUP BY ALL
"""


def prices(c):
    return f.pricing_points(c.pricing.withColumn("export_date", F.to_date("export_time")), AS_OF, ALL)


@query(
    "pricing_analysis",
    f"""SELECT service_id, sku_id, pricing_location, currency_code, units AS current_base_price_units, nanos AS current_base_price_nanos, latest_price_update, pricing_tiers_count,
        {r('price', 6)} AS effective_price_per_unit FROM prices""",
)
def _(c):
    return rounded(prices(c), "effective_price_per_unit", digits=6)


@query(
    "pricing_analysis_nested",
    f"""SELECT service_id, sku_id, pricing_location, currency_code, units AS current_base_price_units, nanos AS current_base_price_nanos,
        {r('CAST(units AS DOUBLE) + nanos / 1e9', 6)} AS effective_price_per_unit, CAST(2 AS INTEGER) AS price_points FROM pricing""",
)
def _(c):
    def point(time, units):
        price = F.struct("currency_code", units.alias("units"), "nanos")
        return F.struct(time.alias("effective_time"), F.struct(F.array(F.struct(F.lit(0.0).alias("start_usage_amount"), price.alias("unit_price"))).alias("tiered_rates")).alias("pricing_expression"))

    older = point(F.col("effective_time") - F.expr("INTERVAL 1 DAY"), F.lit("0"))
    export = c.pricing.withColumns({"export_date": F.to_date("export_time"), "pricing_info": F.array(point(F.col("effective_time"), F.col("units")), older)})
    return rounded(f.pricing_analysis(export, AS_OF), "effective_price_per_unit", digits=6)


@query(
    "cud_utilization",
    f"""SELECT billing_account_id, commitment_id, commitment_status, CAST(date_trunc('month', usage_date) AS DATE) AS usage_month, count(*) AS usage_days, sum(usage_amount) AS total_usage_amount,
        {r('avg(coverage_percentage)')} AS avg_coverage_percentage, {r('sum(list_cost)')} AS total_list_cost, {r('sum(discount_amount)')} AS total_discount_amount, {r('sum(net_cost)')} AS total_net_cost,
        {r('sum(discount_amount) / sum(list_cost) * 100')} AS overall_discount_percentage, {r('avg(commitment_utilization_percentage)')} AS avg_utilization_percentage,
        min(commitment_utilization_percentage) AS min_utilization_percentage, max(commitment_utilization_percentage) AS max_utilization_percentage, min(commitment_start_date) AS commitment_start_date,
        max(commitment_end_date) AS commitment_end_date, CAST(max(commitment_end_date) - DATE '2001-11-05' AS INTEGER) AS days_until_expiry,
        CASE WHEN avg(commitment_utilization_percentage) < 50 THEN 'UNDER_UTILIZED' WHEN avg(commitment_utilization_percentage) < 80 THEN 'MODERATE' WHEN avg(commitment_utilization_percentage) < 95 THEN 'WELL_UTILIZED' ELSE 'OVER_UTILIZED' END AS utilization_status
        FROM cud WHERE commitment_status = 'ACTIVE' GROUP BY ALL""",
)
def _(c):
    rows = f.cud_utilization(c.cud, AS_OF, ALL)
    return rounded(rows, "avg_coverage_percentage", "total_list_cost", "total_discount_amount", "total_net_cost", "overall_discount_percentage", "avg_utilization_percentage")


ORACLE_VIEWS["enhanced"] = """
SELECT l_orderkey, l_linenumber, b.billing_account_id, service_name, sku_description, b.project_id, b.usage_date, b.usage_amount, usage_unit, cost AS actual_cost, currency, price AS effective_price_per_unit,
       CASE WHEN price IS NOT NULL AND b.usage_amount > 0 THEN b.usage_amount * price END AS calculated_list_cost, coalesce(d, 0) AS cud_discount_applied, coalesce(cv, 0) AS cud_coverage_percentage,
       CASE WHEN price IS NOT NULL AND b.usage_amount > 0 THEN (cost - coalesce(d, 0)) / nullif(b.usage_amount * price, 0) * 100 END AS cost_efficiency_percentage,
       CASE WHEN coalesce(cv, 0) = 0 THEN 'NO_CUD_COVERAGE' WHEN coalesce(cv, 0) < 50 THEN 'LOW_CUD_COVERAGE' WHEN coalesce(cv, 0) < 80 THEN 'MODERATE_CUD_COVERAGE' ELSE 'HIGH_CUD_COVERAGE' END AS cud_optimization_status,
       b.location
FROM billing AS b LEFT JOIN prices AS p ON b.service_id = p.service_id AND b.sku_id = p.sku_id AND (p.pricing_location = b.location OR p.pricing_location IS NULL)
LEFT JOIN (SELECT billing_account_id, project_id, service_id, sku_id, usage_date, sum(discount_amount) AS d, avg(coverage_percentage) AS cv FROM cud GROUP BY ALL) AS c
ON b.billing_account_id = c.billing_account_id AND b.project_id = c.project_id AND b.service_id = c.service_id AND b.sku_id = c.sku_id AND b.usage_date = c.usage_date
WHERE cost > 0.001
"""
ENHANCED = ["calculated_list_cost", "cud_discount_applied", "cud_coverage_percentage", "cost_efficiency_percentage", "effective_price_per_unit"]
ENHANCED_SQL = "SELECT * REPLACE (" + ", ".join(f"{r(m)} AS {m}" for m in ENHANCED) + ") FROM enhanced"


def enhanced(c):
    return f.enhanced_cost(c.billing, prices(c), c.cud, AS_OF, ALL)


@query("enhanced_cost", ENHANCED_SQL)
def _(c):
    return rounded(enhanced(c), *ENHANCED)


@query(
    "enhanced_cost_by_service",
    f"""SELECT service_name, count(*) AS records, {r('sum(actual_cost)', 2)} AS total_cost, {r('sum(cud_discount_applied)', 2)} AS total_cud_savings, {r('avg(cost_efficiency_percentage)', 2)} AS avg_efficiency
        FROM enhanced GROUP BY 1 ORDER BY total_cost DESC LIMIT 10""",
)
def _(c):
    return rounded(f.enhanced_cost_by_service(enhanced(c)), "total_cost", "total_cud_savings", "avg_efficiency", digits=2)


@query("enhanced_cost_top", ENHANCED_SQL + " ORDER BY actual_cost DESC, l_orderkey, l_linenumber, effective_price_per_unit NULLS FIRST LIMIT 20")
def _(c):
    return rounded(f.enhanced_cost_top(enhanced(c)), *ENHANCED)


@query(
    "source_status",
    f"""SELECT 'billing' AS source, count(*) AS records, {r('sum(cost)', 2)} AS total_cost, max(usage_date) AS latest_data FROM billing
        UNION ALL SELECT 'pricing', count(*), NULL, max(CAST(export_time AS DATE)) FROM pricing UNION ALL SELECT 'cud', count(*), {r('sum(discount_amount)', 2)}, max(usage_date) FROM cud""",
)
def _(c):
    priced = c.pricing.withColumn("export_date", F.to_date("export_time"))
    return rounded(f.source_status({"billing": (c.billing, "cost", "usage_date"), "pricing": (priced, None, "export_date"), "cud": (c.cud, "discount_amount", "usage_date")}), "total_cost", digits=2)


@query("export_stats", f"SELECT count(*) AS total_rows, min(usage_date) AS first_date, max(usage_date) AS last_date, count(DISTINCT service_name) AS services, {r('sum(cost)', 2)} AS total_cost FROM billing")
def _(c):
    return rounded(f.export_stats(c.billing), "total_cost", digits=2)


@query("pricing_stats", "SELECT count(*) AS pricing_records, count(DISTINCT service_id) AS services_with_pricing, count(DISTINCT sku_id) AS skus_with_pricing, max(export_time) AS latest_pricing_update FROM pricing")
def _(c):
    return f.pricing_stats(c.pricing)


@query("cud_stats", f"SELECT count(*) AS cud_records, count(DISTINCT commitment_id) AS active_commitments, {r('sum(discount_amount)', 2)} AS total_discounts, {r('avg(commitment_utilization_percentage)')} AS avg_utilization FROM cud")
def _(c):
    return rounded(rounded(f.cud_stats(c.cud, AS_OF, ALL), "total_discounts", digits=2), "avg_utilization")


@query("recent_lines", "SELECT * FROM billing ORDER BY usage_start_time DESC, l_orderkey, l_linenumber LIMIT 5")
def _(c):
    return f.recent_lines(c.billing)


@query("service_coverage", f"SELECT service_name, count(*) AS line_items, {r('sum(cost)')} AS total_cost, count(DISTINCT usage_date) AS days_active FROM billing GROUP BY 1")
def _(c):
    return rounded(f.service_coverage(c.billing, AS_OF, ALL), "total_cost")


@query(
    "coverage_comparison",
    f"""WITH a AS (SELECT usage_date, sum(cost) AS c FROM billing GROUP BY 1), b AS (SELECT dt, sum(cost_usd) AS c FROM job_costs GROUP BY 1)
        SELECT 'all services' AS scope, {r('avg(c)')} AS daily_average, {r('avg(c) * 30')} AS monthly_projection, {r('sum(c)', 2)} AS total, count(*) AS days FROM a
        UNION ALL SELECT 'query jobs only', {r('avg(c)')}, {r('avg(c) * 30')}, {r('sum(c)', 2)}, count(*) FROM b""",
)
def _(c):
    return rounded(rounded(f.coverage_comparison(c.billing, f.job_cost(c.jobs, AS_OF, ALL), AS_OF, ALL), "daily_average", "monthly_projection"), "total", digits=2)


GAP = ["known_daily", "known_monthly", "target_monthly", "missing_monthly", "missing_percentage", "daily_gap"]


@query(
    "cost_gap",
    f"""WITH k AS (SELECT avg(c) AS d FROM (SELECT usage_date, sum(cost) AS c FROM billing WHERE service_name = 'BigQuery' GROUP BY 1))
        SELECT {r('d')} AS known_daily, {r('d * 30')} AS known_monthly, {r('135000.0')} AS target_monthly, {r('135000 - d * 30')} AS missing_monthly, {r('(135000 - d * 30) / 135000 * 100')} AS missing_percentage,
        {r('135000 / 30.0 - d')} AS daily_gap FROM k""",
)
def _(c):
    return rounded(f.cost_gap(c.billing, "BigQuery", 135000.0), *GAP)


@query(
    "resource_inventory",
    """SELECT asset_type, count(*) AS resources, count(*) FILTER (WHERE json_extract_string(payload, '$.state') = 'RUNNING') AS running,
       regexp_matches(asset_type, '^(compute|storage|run|cloudsql|container|cloudfunctions)') AS high_cost FROM assets GROUP BY 1""",
)
def _(c):
    return f.resource_inventory(c.assets)


ID_OF = "CASE service_name " + " ".join(f"WHEN '{n}' THEN '{i}'" for i, n in SERVICE_NAMES.items()) + " ELSE service_id END"


@query("service_names", f"SELECT {ID_OF} AS service_id, service_name, count(*) AS n FROM billing GROUP BY ALL")
def _(c):
    lookup = F.create_map(*[F.lit(x) for i, name in SERVICE_NAMES.items() for x in (name, i)])
    lines = c.billing.select(F.coalesce(lookup[F.col("service_name")], "service_id").alias("service_id"))
    return f.with_service_name(lines, f.service_names(c.spark)).groupBy("service_id", "service_name").agg(F.count("*").alias("n"))
