"""Billing, pricing, commitment and job-cost marts.

Joins here are plain equi-joins without hints: Spark broadcasts a side only when its measured size allows, and splits skewed
partitions otherwise. Sides that would multiply rows are aggregated to one row per join key first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.contracts import BILLED_JOB_TYPES, SERVICE_NAMES, USD_PER_TIB
from lumenlog.functions.columns import count_if, extract
from lumenlog.functions.timewin import day, days_back, month_start, week_start
from lumenlog.session import materialize
from lumenlog.sources.io import table_exists

TIB = float(1024**4)


# --- query jobs -------------------------------------------------------------------------------------------------------


def materialize_jobs(jobs: DataFrame, on: str) -> DataFrame:
    """The job rows of one day, labels as JSON, a query hash and the list of tables read."""
    rows = jobs.filter(F.to_date("creation_time") == F.to_date(F.lit(on)))
    return rows.select(
        F.to_date("creation_time").alias("dt"),
        "job_id",
        "project_id",
        F.col("user_name").alias("user_email"),
        F.to_json("labels").alias("labels"),
        "total_bytes_processed",
        "total_slot_ms",
        "cache_hit",
        "statement_type",
        F.col("query_hash"),
        F.transform("referenced_tables", lambda t: t["table_id"]).alias("referenced_tables"),
    )


def job_cost(jobs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """On-demand price of finished jobs; jobs that billed no bytes cost nothing."""
    billed = jobs.filter(days_back("dt", as_of, days) & F.col("job_type").isin(BILLED_JOB_TYPES) & (F.col("state") == "DONE"))
    cost = F.coalesce(F.col("total_bytes_billed").cast("double") / F.lit(TIB) * F.lit(USD_PER_TIB), F.lit(0.0))
    return billed.select(
        "dt",
        "project_id",
        F.coalesce("statement_type", F.lit("QUERY")).alias("statement_type"),
        cost.alias("cost_usd"),
        F.lit("USD").alias("currency"),
        F.lit("BigQuery").alias("service_name"),
        F.col("job_type").alias("sku_description"),
        F.col("creation_time").alias("usage_start_time"),
        "job_id",
        "user_name",
        "total_bytes_processed",
        "cache_hit",
        F.lit("information_schema").alias("source_system"),
        "total_slot_ms",
        "total_bytes_billed",
        "state",
    )


def label_value(labels: str | Column, key: str) -> Column:
    """Value of a label out of an array of {key, value}."""
    return F.get(F.filter(labels, lambda x: x["key"] == key), 0)["value"]


def export_to_jobs(nested: DataFrame, as_of: str, days: int = 30, service: str | None = "BigQuery", label: str = "statement_type") -> DataFrame:
    """Positive export lines as job-cost rows; of one service with the statement type from a label, or of all services."""
    rows = nested.filter(days_back("usage_date", as_of, days) & (F.col("cost") > 0))
    if service:
        rows = rows.filter(F.col("service.description") == service)
    kind = F.coalesce(label_value("labels", label), F.lit("unknown")) if service else F.col("service.description")
    return rows.select(
        F.to_date("usage_start_time").alias("dt"),
        F.col("project.id").alias("project_id"),
        kind.alias("statement_type"),
        F.col("cost").alias("cost_usd"),
        "currency",
        F.col("service.description").alias("service_name"),
        F.col("sku.description").alias("sku_description"),
        "usage_start_time",
        "usage_end_time",
        F.lit(None).cast("string").alias("job_id"),
        F.lit("billing_export").alias("source_system"),
    )


def daily_job_cost(jobs: DataFrame, limit: int = 7) -> DataFrame:
    """Jobs, cost and GB per day, newest days first."""
    daily = jobs.groupBy("dt").agg(
        F.count("*").alias("jobs"), F.sum("cost_usd").alias("daily_cost"), (F.sum("total_bytes_processed") / 1e9).alias("gb_processed")
    )
    return daily.orderBy(F.desc("dt")).limit(limit)


# --- billing lines ----------------------------------------------------------------------------------------------------


def flatten_billing(nested: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Nested export lines on the flat detail columns."""
    have = set(nested.columns)

    def opt(column: str) -> Column:
        return F.col(column) if column in have else F.lit(None).cast("string")

    return nested.filter(days_back("usage_date", as_of, days)).select(
        "billing_account_id",
        F.col("service.id").alias("service_id"),
        F.col("service.description").alias("service_name"),
        F.col("sku.id").alias("sku_id"),
        F.col("sku.description").alias("sku_description"),
        F.col("project.id").alias("project_id"),
        F.col("project.name").alias("project_name"),
        F.to_date("usage_start_time").alias("usage_date"),
        "usage_start_time",
        "usage_end_time",
        "cost",
        "currency",
        opt("cost_type").alias("cost_type"),
        F.coalesce("usage.amount", F.lit(0.0)).alias("usage_amount"),
        F.col("usage.unit").alias("usage_unit"),
        F.col("location.location").alias("location"),
        F.col("location.country").alias("country"),
        F.col("location.region").alias("region"),
        F.to_json("labels").alias("labels") if "labels" in have else F.lit(None).cast("string").alias("labels"),
        opt("invoice_month").alias("invoice_month"),
        F.lit("comprehensive_billing_export").alias("source_system"),
        F.lit("v3").alias("schema_version"),
    )


def ingest_billing(flat: DataFrame, target: DataFrame, start: str, end: str, by_account: bool = True) -> DataFrame:
    """Lines of the range whose (account, day) is not stored yet, ready to append.

    ``by_account=False`` skips a day as soon as any account has it.
    """
    key = ["billing_account_id", "usage_date"] if by_account else ["usage_date"]
    span = F.col("usage_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    stored = target.filter(span).select(*key).distinct()
    return flat.filter(span).join(stored, key, "left_anti")


def cost_bucket(cost: str | Column = "cost") -> Column:
    c = F.col(cost) if isinstance(cost, str) else cost
    return F.when(c < 0.01, "micro").when(c < 1.0, "small").when(c < 10.0, "medium").when(c < 100.0, "large").otherwise("xlarge")


ARCHIVE_KEYS = "billing_account_id service_id service_name sku_id sku_description project_id usage_unit country region".split()


def _archive_sums(billing: DataFrame) -> DataFrame:
    """Monthly sums that can be added up."""
    return billing.groupBy(
        F.year("usage_date").alias("archive_year"), F.month("usage_date").alias("archive_month"), *ARCHIVE_KEYS, cost_bucket().alias("cost_bucket")
    ).agg(
        F.count("*").alias("record_count"),
        F.sum("cost").alias("total_cost"),
        F.count("cost").alias("cost_count"),
        F.max("cost").alias("max_cost"),
        F.sum("usage_amount").alias("total_usage_amount"),
        F.min("usage_date").alias("period_start"),
        F.max("usage_date").alias("period_end"),
    )


def archive_rollup(billing: DataFrame) -> DataFrame:
    """Monthly cold-storage aggregate of billing lines."""
    return _archive_sums(billing).withColumn("cost_count", F.try_divide("total_cost", "cost_count")).withColumnRenamed("cost_count", "avg_cost")


def _archive_run(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger of an archive: what was counted, and by which run."""
    return spark.read.schema("billing_account_id string, usage_date date, batch_id string, run int").parquet(f"{path}/ledger") if table_exists(spark, f"{path}/ledger") else None


def archive_incremental(billing: DataFrame, path: str, run: int, as_of: str, days: int = 180, batch: str = "batch_id") -> None:
    """Archive what has grown older than ``days`` and was not counted yet, as run number ``run`` of the archive at ``path``.

    Lines are counted by (account, day, batch of the export): a batch that comes late for a day that is archived already is added to
    its month, and nothing is counted twice. A run writes its sums, then its ledger; sums without a ledger do not count, so a run that
    failed is done again under its number. A run that is in the ledger is passed over.
    """
    spark = billing.sparkSession
    ledger = _archive_run(spark, path)
    old = billing.filter(F.col("usage_date") < F.date_sub(day(as_of), days)).withColumn("_batch", F.col(batch).cast("string"))
    if ledger is not None:
        if not ledger.filter(F.col("run") == run).isEmpty():
            return
        same = [old[c].eqNullSafe(ledger[d]) for c, d in (("billing_account_id", "billing_account_id"), ("usage_date", "usage_date"), ("_batch", "batch_id"))]
        old = old.join(ledger, same[0] & same[1] & same[2], "left_anti")
    _archive_sums(old).write.mode("overwrite").parquet(f"{path}/rows/run={run}")
    counted = old.select("billing_account_id", "usage_date", F.col("_batch").alias("batch_id")).distinct()
    counted.write.mode("overwrite").parquet(f"{path}/ledger/run={run}")


def archived(spark: SparkSession, path: str) -> DataFrame:
    """The archive: the sums of all runs that the ledger holds, merged by month and keys."""
    runs = _archive_run(spark, path).select("run").distinct()  # one row for each run
    rows = spark.read.parquet(f"{path}/rows").join(F.broadcast(runs), "run", "left_semi")
    return rows.groupBy("archive_year", "archive_month", *ARCHIVE_KEYS, "cost_bucket").agg(
        F.sum("record_count").alias("record_count"),
        F.sum("total_cost").alias("total_cost"),
        F.try_divide(F.sum("total_cost"), F.sum("cost_count")).alias("avg_cost"),
        F.max("max_cost").alias("max_cost"),
        F.sum("total_usage_amount").alias("total_usage_amount"),
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
    )


def archive_workforce(attribution: DataFrame, archive: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Attribution lines older than ``days`` of days that the archive does not hold yet; a second run adds nothing."""
    old = attribution.filter(F.col("attribution_date") < F.date_sub(day(as_of), days))
    return old.join(archive.select("attribution_date").distinct(), "attribution_date", "left_anti").select(*attribution.columns)


def _per_tib(cost: Column, bytes_billed: Column) -> Column:
    return F.when(bytes_billed > 0, cost / (bytes_billed / F.lit(TIB)))


def _per_slot_second(cost: Column, slot_ms: Column) -> Column:
    return F.when(slot_ms > 0, cost / (slot_ms / F.lit(1000)))


def bq_cost_detail(billing: DataFrame, jobs: DataFrame, service_id: str, per_job: bool = False) -> DataFrame:
    """Warehouse billing lines with the jobs of their project and day.

    By default the jobs of a (project, day) are added up first: one row per line, so costs may be summed. ``per_job=True``
    repeats a line for every job, which multiplies rows; use it on a narrowed range only.
    """
    lines = billing.filter(F.col("service_id") == service_id).select(
        "usage_date", "project_id", "cost", "usage_amount", "sku_description", *[c for c in ("l_orderkey", "l_linenumber") if c in billing.columns]
    )
    j = jobs.withColumn("usage_date", F.to_date("creation_time"))
    if per_job:
        j = j.select("usage_date", "project_id", "job_id", "user_name", "statement_type", "total_bytes_billed", "total_slot_ms", "cache_hit")
    else:
        j = j.groupBy("usage_date", "project_id").agg(
            F.count("*").alias("job_count"),
            F.sum("total_bytes_billed").alias("total_bytes_billed"),
            F.sum("total_slot_ms").alias("total_slot_ms"),
            count_if(F.col("cache_hit")).alias("cache_hits"),
        )
    return lines.join(j, ["usage_date", "project_id"], "left").withColumns(
        {
            "cost_per_tb": _per_tib(F.col("cost"), F.col("total_bytes_billed")),
            "cost_per_slot_second": _per_slot_second(F.col("cost"), F.col("total_slot_ms")),
        }
    )


def _first_word(column: str, words: dict[str, str], default: str) -> Column:
    out = None
    for word, value in words.items():
        hit = F.col(column).contains(word)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def compute_cost_detail(billing: DataFrame) -> DataFrame:
    """Virtual-machine lines with machine family, zone, instance and resource type read from the SKU text."""
    sku = "sku_description"
    return billing.filter(F.col("service_name") == "Compute Engine").select(
        "usage_date",
        "project_id",
        "cost",
        "usage_amount",
        "usage_unit",
        sku,
        extract(sku, "(n1-|n2-|e2-|c2-|m1-|f1-|g1-)[a-z0-9-]+").alias("machine_type"),
        extract(sku, "running in (.+)").alias("zone"),
        _first_word(sku, {"Preemptible": "preemptible", "Spot": "spot"}, "standard").alias("instance_type"),
        _first_word(sku, {"Core": "cpu", "Ram": "memory", "Disk": "storage", "GPU": "gpu"}, "other").alias("resource_type"),
        "location",
    )


def storage_cost_detail(billing: DataFrame) -> DataFrame:
    sku = "sku_description"
    return billing.filter(F.col("service_name") == "Cloud Storage").select(
        "usage_date",
        "project_id",
        "cost",
        "usage_amount",
        "usage_unit",
        sku,
        _first_word(sku, {"Standard": "standard", "Nearline": "nearline", "Coldline": "coldline", "Archive": "archive"}, "unknown").alias("storage_class"),
        _first_word(sku, {"Storage": "storage", "Download": "network", "Egress": "network", "Operation": "operations"}, "other").alias("cost_type"),
        "location",
        "region",
    )


# --- dashboards -------------------------------------------------------------------------------------------------------


def cost_dashboard(billing: DataFrame, workforce: DataFrame, as_of: str, days: int = 90, top_skus: int = 5) -> DataFrame:
    """Who, what, where, when and how much per day, account, service and project."""
    keys = ["usage_date", "billing_account_id", "service_name", "project_id"]
    rows = billing.filter(days_back("usage_date", as_of, days))
    # per SKU first: the group of a hot key shrinks to its SKUs before anything is ranked
    per_sku = rows.groupBy(*keys, "sku_description").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
    ranked = per_sku.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("sku_description")))
    names = F.filter(F.collect_list(F.when(F.col("rank") <= top_skus, F.col("sku_description"))), lambda x: x.isNotNull())
    daily = ranked.groupBy(*keys).agg(
        F.sum("cost").alias("daily_cost"), F.sum("n").alias("line_items"), F.array_join(F.sort_array(names), ", ").alias("top_skus")
    )
    people = workforce.groupBy(F.col("attribution_date").alias("usage_date"), "project_id").agg(
        F.sum("total_attributed_cost").alias("attributed"), F.count_distinct("member_id").alias("members")
    )
    d, cost = F.col("usage_date"), F.col("daily_cost")
    attributed = F.coalesce("attributed", F.lit(0.0))
    return daily.join(people, ["usage_date", "project_id"], "left").select(
        F.coalesce("members", F.lit(0)).alias("who_active_members"),
        F.col("service_name").alias("what_service"),
        F.col("top_skus").alias("what_resources"),
        F.col("project_id").alias("where_project"),
        F.col("billing_account_id").alias("where_billing_account"),
        d.alias("when_date"),
        F.dayofweek(d).alias("when_day_of_week"),
        F.lit("operational").alias("why_purpose"),
        cost.alias("how_much_cost"),
        attributed.alias("how_much_attributed"),
        (cost - attributed).alias("how_much_unattributed"),
        F.col("line_items").alias("how_many_line_items"),
        F.when((cost > 0) & (attributed > 0), attributed / cost).otherwise(0.0).alias("attribution_efficiency"),
        week_start(d).alias("week_start"),
        month_start(d).alias("month_start"),
    )


def top_cost_dashboard(dashboard: DataFrame, as_of: str, days: int = 7, limit: int = 20) -> DataFrame:
    rows = dashboard.filter(days_back("when_date", as_of, days))
    return rows.orderBy(F.desc("how_much_cost"), "when_date", "what_service", "where_project", "where_billing_account").limit(limit)


def cost_recommendations(billing: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rule texts per service and project. The average is per billing line, although the report calls it daily."""
    trend = billing.filter(days_back("usage_date", as_of, days)).groupBy("service_name", "project_id").agg(
        F.avg("cost").alias("avg_daily_cost"), F.stddev_samp("cost").alias("cost_volatility"), F.count_distinct("usage_date").alias("active_days")
    )
    avg, service = F.col("avg_daily_cost"), F.col("service_name")
    rule = (
        F.when((service == "Compute Engine") & (avg > 10), "Consider preemptible instances for non-critical workloads")
        .when((service == "Cloud Storage") & (F.col("cost_volatility") > avg * 0.5), "Review storage class optimization for lifecycle management")
        .when((service == "BigQuery") & (avg > 5), "Implement slot reservations for predictable workloads")
        .otherwise("Monitor usage patterns")
    )
    return trend.filter(avg > 0.10).withColumns(
        {
            "projected_monthly_cost": avg * 30,
            "optimization_recommendation": rule,
            "cost_priority": F.when(avg > 20, "high").when(avg > 5, "medium").otherwise("low"),
        }
    )


def workforce_attribution(direct: DataFrame, billing: DataFrame) -> DataFrame:
    """A member's own cost plus a share of the project-day's billing in proportion to it.

    Totals per project and day come from an aggregate joined back, not from a window, so a busy project is not one task.
    """
    own = direct.groupBy("attribution_date", "member_id", "project_id").agg(F.sum("total_attributed_cost").alias("direct_cost"))
    keys = ["attribution_date", "project_id"]
    totals = own.groupBy(*keys).agg(F.sum("direct_cost").alias("project_direct"))
    shared = billing.groupBy(F.col("usage_date").alias("attribution_date"), "project_id").agg(F.sum("cost").alias("shared_cost"))
    pool = totals.join(shared, keys, "left")
    allocated = F.coalesce(F.try_divide(F.col("direct_cost") * F.col("shared_cost"), F.col("project_direct")), F.lit(0.0))
    return own.join(pool, keys).select(
        "attribution_date",
        "member_id",
        "project_id",
        "direct_cost",
        allocated.alias("allocated_cost"),
        (F.col("direct_cost") + allocated).alias("total_attributed_cost"),
    )


def _above(orgs: DataFrame) -> DataFrame:
    """(org_id, ancestor): every unit with all units above it, one level more each round."""
    links = orgs.filter(F.col("parent_org_id").isNotNull()).select(F.col("org_id").alias("unit"), F.col("parent_org_id").alias("above")).distinct()
    step = found = materialize(links.select(F.col("unit").alias("org_id"), F.col("above").alias("ancestor")), "ancestors")
    while not step.isEmpty():
        higher = step.join(links, F.col("ancestor") == F.col("unit")).select("org_id", F.col("above").alias("ancestor")).distinct()
        step = materialize(higher.join(found, ["org_id", "ancestor"], "left_anti"), "ancestors")
        found = found.unionByName(step)
    return found.filter(F.col("org_id") != F.col("ancestor"))


def org_hierarchy_costs(leaf_costs: DataFrame, orgs: DataFrame) -> DataFrame:
    """Cost per organisation unit including everything below it, however deep: each cost counts for its unit and all above.

    ``child_count`` is the number of direct children. A unit that is its own ancestor adds to the units of its circle once.
    """
    costs = leaf_costs.groupBy("org_id").agg(F.sum("cost").alias("own_cost"), F.count("*").alias("own_lines"))
    tree = orgs.join(costs, "org_id", "left").select("org_id", "org_name", "parent_org_id", F.coalesce("own_cost", F.lit(0.0)).alias("own_cost"))
    below = _above(orgs).join(costs, "org_id", "left").groupBy(F.col("ancestor").alias("org_id")).agg(F.sum(F.coalesce("own_cost", F.lit(0.0))).alias("children_cost"))
    children = orgs.filter(F.col("parent_org_id").isNotNull()).groupBy(F.col("parent_org_id").alias("org_id")).agg(F.count("*").alias("child_count"))
    return tree.join(children, "org_id", "left").join(below, "org_id", "left").select(
        "org_id",
        "org_name",
        "parent_org_id",
        "own_cost",
        F.coalesce("child_count", F.lit(0)).alias("child_count"),
        (F.col("own_cost") + F.coalesce("children_cost", F.lit(0.0))).alias("total_cost"),
    )


# --- pricing and commitments ------------------------------------------------------------------------------------------

PRICE_KEYS = ["service_id", "sku_id", "pricing_location", "currency_code"]


def _unit_price(units: Column, nanos: Column) -> Column:
    return units.cast("double") + nanos.cast("double") / 1e9


def pricing_analysis(export: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Newest price of each exported SKU row, read from its nested price history (first tier of the newest element)."""
    newest = F.array_max(F.transform("pricing_info", lambda p: F.struct(p["effective_time"], p["pricing_expression"]["tiered_rates"][0]["unit_price"].alias("price"))))
    recent = export.filter(days_back("export_date", as_of, days)).withColumn("_newest", newest)
    price = F.col("_newest.price")
    return recent.select(
        *PRICE_KEYS,
        price["units"].alias("current_base_price_units"),
        price["nanos"].alias("current_base_price_nanos"),
        _unit_price(price["units"], price["nanos"]).alias("effective_price_per_unit"),
        F.size("pricing_info").alias("price_points"),
    )


def pricing_points(points: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The same from flat price points: newest point per SKU and location, without collecting any history."""
    order = F.struct("effective_time", "p_partkey")
    newest = points.filter(days_back("export_date", as_of, days)).groupBy(*PRICE_KEYS).agg(
        F.max_by("units", order).alias("current_base_price_units"),
        F.max_by("nanos", order).alias("current_base_price_nanos"),
        F.max("effective_time").alias("latest_price_update"),
        F.count("*").alias("pricing_tiers_count"),
    )
    return newest.withColumn("effective_price_per_unit", _unit_price(F.col("current_base_price_units"), F.col("current_base_price_nanos")))


def cud_utilization(cud: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Discount and utilisation per active commitment and month."""
    active = cud.filter(days_back("usage_date", as_of, days) & (F.col("commitment_status") == "ACTIVE"))
    use = F.col("avg_utilization_percentage")
    grouped = active.groupBy("billing_account_id", "commitment_id", "commitment_status", month_start(F.col("usage_date")).alias("usage_month")).agg(
        F.count("*").alias("usage_days"),
        F.sum("usage_amount").alias("total_usage_amount"),
        F.avg("coverage_percentage").alias("avg_coverage_percentage"),
        F.sum("list_cost").alias("total_list_cost"),
        F.sum("discount_amount").alias("total_discount_amount"),
        F.sum("net_cost").alias("total_net_cost"),
        (F.try_divide(F.sum("discount_amount"), F.sum("list_cost")) * 100).alias("overall_discount_percentage"),
        F.avg("commitment_utilization_percentage").alias("avg_utilization_percentage"),
        F.min("commitment_utilization_percentage").alias("min_utilization_percentage"),
        F.max("commitment_utilization_percentage").alias("max_utilization_percentage"),
        F.min("commitment_start_date").alias("commitment_start_date"),
        F.max("commitment_end_date").alias("commitment_end_date"),
    )
    status = F.when(use < 50, "UNDER_UTILIZED").when(use < 80, "MODERATE").when(use < 95, "WELL_UTILIZED").otherwise("OVER_UTILIZED")
    return grouped.withColumns({"days_until_expiry": F.datediff("commitment_end_date", day(as_of)), "utilization_status": status})


def enhanced_cost(billing: DataFrame, prices: DataFrame, cud: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Billing lines with list price and commitment benefit.

    A price without a location holds everywhere. That rule becomes two equi-joins (exact location, any location) whose price
    sides hold one row per key, instead of one join on a disjunction; a line with both kinds of price appears once for each.
    """
    lines = billing.filter(days_back("usage_date", as_of, days) & (F.col("cost") > 0.001))
    sku = ["service_id", "sku_id"]
    p = prices.select(*sku, F.col("pricing_location").alias("location"), F.col("effective_price_per_unit").alias("price"))
    exact = p.filter(F.col("location").isNotNull()).groupBy(*sku, "location").agg(F.collect_list("price").alias("here"))
    anywhere = p.filter(F.col("location").isNull()).groupBy(*sku).agg(F.collect_list("price").alias("global"))
    benefit_keys = ["billing_account_id", "project_id", "service_id", "sku_id", "usage_date"]
    benefits = cud.filter(days_back("usage_date", as_of, days)).groupBy(*benefit_keys).agg(
        F.sum("discount_amount").alias("discount"), F.avg("coverage_percentage").alias("coverage")
    )
    priced = lines.join(exact, [*sku, "location"], "left").join(anywhere, sku, "left").join(benefits, benefit_keys, "left")
    empty = F.array().cast("array<double>")
    priced = priced.withColumn("price", F.explode_outer(F.concat(F.coalesce("here", empty), F.coalesce("global", empty))))
    price, amount = F.col("price"), F.col("usage_amount")
    listed = F.when(price.isNotNull() & (amount > 0), amount * price)
    discount, coverage = F.coalesce("discount", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0))
    status = (
        F.when(coverage == 0, "NO_CUD_COVERAGE").when(coverage < 50, "LOW_CUD_COVERAGE").when(coverage < 80, "MODERATE_CUD_COVERAGE").otherwise("HIGH_CUD_COVERAGE")
    )
    keys = [c for c in ("l_orderkey", "l_linenumber") if c in billing.columns]
    return priced.select(
        *keys,
        "billing_account_id",
        "service_name",
        "sku_description",
        "project_id",
        "usage_date",
        "usage_amount",
        "usage_unit",
        F.col("cost").alias("actual_cost"),
        "currency",
        price.alias("effective_price_per_unit"),
        listed.alias("calculated_list_cost"),
        discount.alias("cud_discount_applied"),
        coverage.alias("cud_coverage_percentage"),
        (F.try_divide(F.col("cost") - discount, listed) * 100).alias("cost_efficiency_percentage"),
        status.alias("cud_optimization_status"),
        "location",
    )


def enhanced_cost_by_service(enhanced: DataFrame, limit: int = 10) -> DataFrame:
    grouped = enhanced.groupBy("service_name").agg(
        F.count("*").alias("records"),
        F.sum("actual_cost").alias("total_cost"),
        F.sum("cud_discount_applied").alias("total_cud_savings"),
        F.avg("cost_efficiency_percentage").alias("avg_efficiency"),
    )
    return grouped.orderBy(F.desc("total_cost"), "service_name").limit(limit)


def enhanced_cost_top(enhanced: DataFrame, limit: int = 20) -> DataFrame:
    return enhanced.orderBy(F.desc("actual_cost"), "l_orderkey", "l_linenumber", "effective_price_per_unit").limit(limit)


# --- status and coverage ----------------------------------------------------------------------------------------------


def source_status(sources: dict[str, tuple[DataFrame, str | None, str]]) -> DataFrame:
    """Rows, cost and newest day of each source, given as name -> (rows, cost column, date column)."""
    parts = []
    for name, (df, cost, date) in sources.items():
        total = F.sum(cost) if cost else F.lit(None).cast("double")
        parts.append(df.agg(F.lit(name).alias("source"), F.count("*").alias("records"), total.alias("total_cost"), F.max(date).alias("latest_data")))
    return reduce(DataFrame.unionByName, parts)


def export_stats(billing: DataFrame) -> DataFrame:
    return billing.agg(
        F.count("*").alias("total_rows"),
        F.min("usage_date").alias("first_date"),
        F.max("usage_date").alias("last_date"),
        F.count_distinct("service_name").alias("services"),
        F.sum("cost").alias("total_cost"),
    )


def pricing_stats(pricing: DataFrame) -> DataFrame:
    return pricing.agg(
        F.count("*").alias("pricing_records"),
        F.count_distinct("service_id").alias("services_with_pricing"),
        F.count_distinct("sku_id").alias("skus_with_pricing"),
        F.max("export_time").alias("latest_pricing_update"),
    )


def cud_stats(cud: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return cud.filter(days_back("usage_date", as_of, days)).agg(
        F.count("*").alias("cud_records"),
        F.count_distinct("commitment_id").alias("active_commitments"),
        F.sum("discount_amount").alias("total_discounts"),
        F.avg("commitment_utilization_percentage").alias("avg_utilization"),
    )


def recent_lines(billing: DataFrame, limit: int = 5) -> DataFrame:
    return billing.orderBy(F.desc("usage_start_time"), "l_orderkey", "l_linenumber").limit(limit)


def service_coverage(billing: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return billing.filter(days_back("usage_date", as_of, days)).groupBy("service_name").agg(
        F.count("*").alias("line_items"), F.sum("cost").alias("total_cost"), F.count_distinct("usage_date").alias("days_active")
    )


def coverage_comparison(billing: DataFrame, jobs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Monthly projection of all captured cost next to that of query jobs alone (average day times thirty)."""

    def projection(df: DataFrame, name: str, date: str, cost: str) -> DataFrame:
        daily = df.filter(days_back(date, as_of, days)).groupBy(date).agg(F.sum(cost).alias("c"))
        one = daily.agg(F.avg("c").alias("daily_average"), F.sum("c").alias("total"), F.count("*").alias("days"))
        return one.select(F.lit(name).alias("scope"), "daily_average", (F.col("daily_average") * 30).alias("monthly_projection"), "total", "days")

    return projection(billing, "all services", "usage_date", "cost").unionByName(projection(jobs, "query jobs only", "dt", "cost_usd"))


def cost_gap(billing: DataFrame, service: str, target_monthly: float) -> DataFrame:
    """How much of a known monthly bill the captured cost of one service leaves unexplained."""
    daily = billing.filter(F.col("service_name") == service).groupBy("usage_date").agg(F.sum("cost").alias("c"))
    known = daily.agg(F.avg("c").alias("known_daily"))
    monthly = F.col("known_daily") * 30
    target = F.lit(target_monthly)
    return known.select(
        "known_daily",
        monthly.alias("known_monthly"),
        target.alias("target_monthly"),
        (target - monthly).alias("missing_monthly"),
        ((target - monthly) / target * 100).alias("missing_percentage"),
        (target / 30 - F.col("known_daily")).alias("daily_gap"),
    )


# Resource kinds that usually cause high cost.
HIGH_COST_KINDS = ["compute", "storage", "run", "cloudsql", "container", "cloudfunctions"]


def resource_inventory(assets: DataFrame) -> DataFrame:
    """Assets per type, how many run, and whether the type is known to be expensive."""
    return assets.groupBy("asset_type").agg(
        F.count("*").alias("resources"), count_if(F.get_json_object("payload", "$.state") == "RUNNING").alias("running")
    ).withColumn("high_cost", F.col("asset_type").rlike("^(" + "|".join(HIGH_COST_KINDS) + ")"))


def service_names(spark: SparkSession) -> DataFrame:
    """The fixed id-to-name table of billed services."""
    return spark.createDataFrame(list(SERVICE_NAMES.items()), "service_id string, service_name string")


def with_service_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Look up the service name; unknown ids keep their id. The lookup holds ten fixed rows, hence the broadcast."""
    found = df.join(F.broadcast(names.withColumnRenamed("service_name", "_name")), "service_id", "left")
    return found.withColumn("service_name", F.coalesce("_name", "service_id")).drop("_name")
