"""Reports over recorded benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.stats import exact_quantiles


def report(runs: DataFrame, run_id: str) -> DataFrame:
    """Mean, median and 95th percentile latency per scenario of one run; failed queries do not count."""
    ok = runs.filter((F.col("run_id") == run_id) & F.col("error").isNull())
    mean = ok.groupBy("scenario").agg(F.avg("latency_ms").alias("avg_ms"))
    return mean.join(exact_quantiles(ok, ["scenario"], "latency_ms", {"p50": 0.5, "p95": 0.95}), "scenario")


def previous_run(runs: DataFrame, run_id: str) -> str | None:
    """The latest other run."""
    others = runs.filter(F.col("run_id") != run_id).groupBy("run_id").agg(F.min("started_at").alias("at"))
    return others.agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id")).first()["run_id"]


def regression(runs: DataFrame, run_id: str, baseline: str) -> DataFrame:
    """Change of the percentiles against a baseline run; more than 10 ms (median) or 50 ms (95th) is a regression."""
    now, old = report(runs, run_id), report(runs, baseline).select("scenario", F.col("p50").alias("old_p50"), F.col("p95").alias("old_p95"))
    p50, p95 = F.col("p50") - F.col("old_p50"), F.col("p95") - F.col("old_p95")
    return now.join(old, "scenario").select(
        "scenario", p50.alias("p50_diff"), p95.alias("p95_diff"), F.when((p50 > 10) | (p95 > 50), "REGRESSION").otherwise("OK").alias("status")
    )


def tuning_flags(runs: DataFrame, run_id: str, baseline: str, recalls: DataFrame | None = None) -> DataFrame:
    """Scenarios more than 10 % slower than the baseline, and those whose recall at ten is below 0.8."""
    ok = runs.filter(F.col("error").isNull() & F.col("run_id").isin(run_id, baseline)).groupBy("scenario").agg(
        F.avg(F.when(F.col("run_id") == run_id, F.col("latency_ms"))).alias("avg_ms"),
        F.avg(F.when(F.col("run_id") == baseline, F.col("latency_ms"))).alias("baseline_ms"),
    )
    slow = F.col("avg_ms") > F.coalesce("baseline_ms", "avg_ms") * 1.1
    flags = ok.filter(F.col("avg_ms").isNotNull()).withColumn("slower", slow)
    if recalls is None:
        return flags
    return flags.join(recalls, "scenario", "left").withColumn("low_recall", F.coalesce(F.col("recall") < 0.8, F.lit(False)))


def regression_gate(runs: DataFrame, run_id: str, baseline: str) -> DataFrame:
    """Relative change of the median; a rise of more than 10 % fails the gate."""
    now, old = report(runs, run_id), report(runs, baseline).select("scenario", F.col("p50").alias("old_p50"))
    change = F.try_divide(F.col("p50") - F.col("old_p50"), F.col("old_p50"))
    return now.join(old, "scenario").select("scenario", change.alias("p50_change"), (change <= 0.10).alias("passed"))


def recall_gate(now: DataFrame, before: DataFrame) -> DataFrame:
    """A drop of the mean recall of more than 5 % fails the gate."""
    both = now.agg(F.avg("recall").alias("r")).select(F.lit("now").alias("at"), "r").unionByName(before.agg(F.avg("recall").alias("r")).select(F.lit("before").alias("at"), "r"))
    one = both.agg(F.max(F.when(F.col("at") == "now", F.col("r"))).alias("recall"), F.max(F.when(F.col("at") == "before", F.col("r"))).alias("old_recall"))
    return one.withColumn("passed", F.col("recall") >= F.col("old_recall") * 0.95)
