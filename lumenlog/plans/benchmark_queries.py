"""Named queries: benchmark reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.operators import benchmarks as b
from lumenlog.plans.registry import query, r, rounded
from lumenlog.plans.search_queries import CELLS, recalls
from lumenlog.session import materialize

OK = "FROM bench WHERE error IS NULL"


def _run(run: str) -> str:
    return f"SELECT scenario, avg(latency_ms) AS a, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95 {OK} AND run_id = '{run}' GROUP BY 1"


@query("bench_report", f"SELECT scenario, {r('a')} AS avg_ms, {r('p50')} AS p50, {r('p95')} AS p95 FROM ({_run('run-1')}) AS x")
def _(c):
    return rounded(b.report(c.bench, "run-1"), "avg_ms", "p50", "p95")


BOTH = f"WITH n AS ({_run('run-1')}), o AS ({_run('run-0')})"


@query(
    "bench_regression",
    f"{BOTH} SELECT n.scenario, {r('n.p50 - o.p50')} AS p50_diff, {r('n.p95 - o.p95')} AS p95_diff, CASE WHEN n.p50 - o.p50 > 10 OR n.p95 - o.p95 > 50 THEN 'REGRESSION' ELSE 'OK' END AS status FROM n JOIN o ON n.scenario = o.scenario",
)
def _(c):
    return rounded(b.regression(c.bench, "run-1", b.previous_run(c.bench, "run-1")), "p50_diff", "p95_diff")


@query(
    "tuning_flags",
    f"{BOTH} SELECT n.scenario, {r('n.a')} AS avg_ms, {r('o.a')} AS baseline_ms, n.a > o.a * 1.1 AS slower FROM n JOIN o ON n.scenario = o.scenario",
)
def _(c):
    return rounded(b.tuning_flags(c.bench, "run-1", "run-0"), "avg_ms", "baseline_ms")


@query("regression_gate", f"{BOTH} SELECT n.scenario, {r('(n.p50 - o.p50) / o.p50')} AS p50_change, (n.p50 - o.p50) / o.p50 <= 0.10 AS passed FROM n JOIN o ON n.scenario = o.scenario")
def _(c):
    return rounded(b.regression_gate(c.bench, "run-1", "run-0"), "p50_change")


@query(
    "tuning_flags_recall",
    f"{BOTH} SELECT n.scenario, {r('n.a')} AS avg_ms, {r('o.a')} AS baseline_ms, n.a > o.a * 1.1 AS slower, n.scenario = 'view' AS low_recall FROM n JOIN o ON n.scenario = o.scenario",
)
def _(c):
    # One scenario searches every cell, another a single one.
    every, one = (recalls(c, n).agg(F.avg("recall").alias("recall")) for n in (CELLS, 1))
    known = every.select(F.lit("click").alias("scenario"), "recall").unionByName(one.select(F.lit("view").alias("scenario"), "recall"))
    return rounded(b.tuning_flags(c.bench, "run-1", "run-0", known).drop("recall"), "avg_ms", "baseline_ms")


@query("recall_gate", "SELECT CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS old_recall, true AS passed UNION ALL SELECT CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), false")
def _(c):
    good = materialize(recalls(c, CELLS), "recalls")  # the gate reads it four times
    bad = good.withColumn("recall", F.col("recall") - 1)
    return b.recall_gate(good, good).unionByName(b.recall_gate(bad, good))
