"""How wide rows come to be stored: pieces of bounded size, and no shuffle of what has been parsed."""

import datetime as dt
import math

from pyspark.sql import functions as F

from lumenlog.adapters import Tables
from lumenlog.operators.aggregates import services_hourly
from lumenlog.plans import shapes
from lumenlog.session import pieces, widen


def _events(spark, folder, n=3000):
    day = F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 3)  # one day has most rows
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(day)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ["click", "view", "error", "purchase", "signup"])), (F.col("id") % 5 + 1).cast("int")).alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return Tables(spark, folder)


def test_pieces_grow_with_the_input(spark, folder):
    events = _events(spark, folder).events
    few, many = pieces(events, 1 << 30), pieces(events, 500)
    assert few == min(64, spark.sparkContext.defaultParallelism) < many
    assert widen(events, "event_id", piece_bytes=500).rdd.getNumPartitions() == many


def test_a_large_day_is_stored_in_pieces(spark, folder, monkeypatch):
    monkeypatch.setattr(shapes, "STORED_BYTES", 500)
    stored = shapes.unified(_events(spark, folder))
    files = stored.filter(F.col("log_date") == "2024-01-01").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 8 and max(r["count"] for r in files) < 1000 and stored.count() == 3000


def test_hourly_quantiles_move_no_sketches(spark):
    """Discrete quantiles by plain counting; the plan sends counts around, no sketch."""
    rows = spark.range(4000).select(
        F.to_date(F.lit("2024-01-01")).alias("log_date"), F.lit(dt.datetime(2024, 1, 1, 5)).alias("event_timestamp"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("string").alias("service_name"),
        F.lit("prod").alias("environment"), F.lit("INFO").alias("severity"), (F.col("id") % 5 == 0).alias("is_error"), (F.col("id") % 2 == 0).alias("is_request"),
        F.when((F.col("id") % 3 > 0) & (F.col("id") % 4 != 2), (F.col("id") * 7919 % 1009).cast("double")).alias("http_latency_ms"),
    )
    got = services_hourly(rows)
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    all_ = rows.collect()
    for r in got.collect():
        own = [x for x in all_ if x["service_name"] == r["service_name"]]
        v = sorted(x["http_latency_ms"] for x in own if x["http_latency_ms"] is not None)
        assert (r["log_count"], r["error_count"], r["request_count"]) == (len(own), sum(x["is_error"] for x in own), sum(x["is_request"] for x in own))
        assert [r[f"p{p}_latency_ms"] for p in (50, 95, 99)] == [v[math.ceil(len(v) * p / 100) - 1] if v else None for p in (50, 95, 99)]
        assert r["avg_latency_ms"] is None if not v else math.isclose(r["avg_latency_ms"], sum(v) / len(v))
