"""Alert rules over sliding windows, as streams.

Rows are first gathered into panes, one for each step of the window, whose state can be merged: counts, and a sketch of the latencies
as bytes. A window adds up its panes, so a row is counted once however many windows it is in; an hour that moves by minutes merges 60
small rows. Panes and windows are both closed by the watermark and written once, in append mode; later rows are left out.
The same functions work on a table, where everything is closed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.columns import count_if
from lumenlog.streaming.jobs import append_stream

STEP = "1 minute"
DELAY = "15 minutes"
#: Share of the rows above the limit from which the 95th percentile is above it.
ABOVE_P95 = 0.05


@dataclass(frozen=True)
class Rule:
    """What is measured (``server_errors``, ``slow``, ``clusters`` or ``denied``), over which window, and when it fires."""

    name: str
    measure: str
    window: str
    threshold: float
    at_least: bool = False


# The rules, their windows and thresholds.
RULES = [
    Rule("5xx Rate Alert", "server_errors", "5 minutes", 10),
    Rule("Latency P95 Alert", "slow", "1 hour", 5.0),
    Rule("Error Cluster Growth", "clusters", "10 minutes", 1, at_least=True),
    Rule("Audit Anomalies", "denied", "1 hour", 5),
]
#: Errors with one fingerprint beyond which they are a cluster.
CLUSTER_SIZE = 5


def _timed(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    return rows.withWatermark(ts, delay) if rows.isStreaming else rows.filter(F.col(ts).isNotNull())


def panes(rows: DataFrame, ts: str, slow: float, keys: list[str] | None = None, step: str = STEP, delay: str = DELAY) -> DataFrame:
    """Mergeable state of every step: rows, server errors, refusals, timed rows, those slower than ``slow``, and a latency sketch.

    Expects ``status``, ``latency_s`` and ``denied``; with ``keys`` a pane is kept for each of their values.
    """
    return _timed(rows, ts, delay).groupBy(F.window(ts, step).alias("pane"), *(keys or [])).agg(
        F.count("*").alias("rows"),
        count_if(F.col("status") >= 500).alias("server_errors"),
        count_if(F.col("denied")).alias("denied"),
        F.count("latency_s").alias("timed"),
        count_if(F.col("latency_s") > slow).alias("slow"),
        F.kll_sketch_agg_double(F.col("latency_s").cast("double")).alias("latencies"),
    )


def _windows(parts: DataFrame, size: str, step: str) -> Column:
    at = F.window_time("pane") if parts.isStreaming else F.col("pane.end") - F.expr("INTERVAL 1 MICROSECOND")
    return F.window(at, size, step).alias("window")


def sliding(parts: DataFrame, size: str, step: str = STEP) -> DataFrame:
    """Panes added up to windows of ``size`` that move by ``step``."""
    merged = parts.groupBy(_windows(parts, size, step)).agg(
        *[F.sum(c).alias(c) for c in ("rows", "server_errors", "denied", "timed", "slow")], F.kll_merge_agg_double("latencies").alias("latencies")
    )
    p95 = F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("latencies", F.lit(0.95)))
    return merged.withColumn("p95", p95).drop("latencies")


def clusters(rows: DataFrame, ts: str, size: str, step: str = STEP, delay: str = DELAY, fingerprint: str = "fingerprint", least: int = CLUSTER_SIZE) -> DataFrame:
    """Fingerprints with more than ``least`` errors in each window: errors per pane and fingerprint, added up, then counted.

    Other rows stay in, under one empty fingerprint: a filter would be moved before the watermark, which then would stand still while
    there are no errors.
    """
    is_error = F.col("severity") == "ERROR"
    marked = _timed(rows, ts, delay).withColumn(fingerprint, F.when(is_error, F.col(fingerprint)))
    errors = marked.groupBy(F.window(ts, step).alias("pane"), fingerprint).agg(count_if(is_error).alias("n"))
    grown = errors.groupBy(_windows(errors, size, step), fingerprint).agg(F.sum("n").alias("n")).filter(F.col("n") > least)
    return grown.groupBy("window").agg(F.count("*").alias("clusters"))


def evaluate(rows: DataFrame, rule: Rule, ts: str, step: str = STEP, delay: str = DELAY) -> DataFrame:
    """rule, window_start, window_end, value, fired: one row for each window that holds a row (for clusters, one).

    The latency rule compares exactly: the 95th percentile is above the threshold when more than a twentieth of the timed rows is, and
    that share is its value.
    """
    if rule.measure == "clusters":
        found = clusters(rows, ts, rule.window, step, delay).withColumn("value", F.col("clusters").cast("double"))
        over = F.col("value") >= rule.threshold if rule.at_least else F.col("value") > rule.threshold
    elif rule.measure == "slow":
        found = sliding(panes(rows, ts, rule.threshold, step=step, delay=delay), rule.window, step)
        found = found.filter("timed > 0").withColumn("value", F.col("slow") / F.col("timed"))
        over = F.col("value") > ABOVE_P95
    else:
        found = sliding(panes(rows, ts, 0.0, step=step, delay=delay), rule.window, step).withColumn("value", F.col(rule.measure).cast("double"))
        over = F.col("value") >= rule.threshold if rule.at_least else F.col("value") > rule.threshold
    return found.select(F.lit(rule.name).alias("rule"), F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "value", over.alias("fired"))


def run_rules(streams: dict[str, DataFrame], path: str, checkpoint: str, ts: str = "ts", rules: list[Rule] | None = None, delay: str = DELAY) -> None:
    """Evaluate each rule over its own stream of the source and append the windows that have closed to ``path/<measure>``."""
    for rule in rules or RULES:
        append_stream(evaluate(streams[rule.measure], rule, ts, delay=delay), f"{path}/{rule.measure}", f"{checkpoint}/{rule.measure}")
