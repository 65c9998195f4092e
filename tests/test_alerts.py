"""Alert rules over streams with late rows and restarts, against plain counting."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lumenlog.streaming import alerts, jobs

SCHEMA = "ts timestamp, status int, latency_s double, denied boolean, severity string, fingerprint string"
START = dt.datetime(2024, 1, 1)
MINUTE = dt.timedelta(minutes=1)


def rows(seed, n=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        latency = rng.choice([None, rng.random() * 5.5])
        out.append((START + dt.timedelta(seconds=7 * i), rng.choice([200, 404, 500, 503]), latency, rng.random() < 0.02, rng.choice(["ERROR", "INFO", None]), f"f{rng.randrange(12)}"))
    return out


def plain(data, rule):
    size = {"5 minutes": 5, "10 minutes": 10, "1 hour": 60}[rule.window]
    windows = {}
    for r in data:
        first = r[0].replace(second=0, microsecond=0)
        for k in range(size):
            windows.setdefault(first - k * MINUTE, []).append(r)
    out = {}
    for start, held in windows.items():
        if rule.measure == "server_errors":
            n = sum(r[1] >= 500 for r in held)
            out[start] = (n, n > 10)
        elif rule.measure == "denied":
            n = sum(r[3] for r in held)
            out[start] = (n, n > 5)
        elif rule.measure == "slow":
            timed = sorted(r[2] for r in held if r[2] is not None)
            if timed:
                p95 = timed[math.ceil(0.95 * len(timed) - 1e-9) - 1]
                out[start] = (sum(x > 5 for x in timed) / len(timed), p95 > 5)
        else:
            by = {}
            for r in held:
                if r[4] == "ERROR":
                    by[r[5]] = by.get(r[5], 0) + 1
            n = sum(x > 5 for x in by.values())
            if n:
                out[start] = (n, n >= 1)
    return out


def got(df):
    return {r.window_start: (r.value, r.fired) for r in df.collect()}


@pytest.mark.parametrize("rule", alerts.RULES, ids=lambda r: r.measure)
def test_rules_on_a_table(spark, rule):
    data = rows(1)
    df = spark.createDataFrame(data + [(None, 500, 9.0, True, "ERROR", "f0")], SCHEMA)
    want = plain(data, rule)
    assert got(alerts.evaluate(df, rule, "ts")) == want and len({fired for _, fired in want.values()}) == (1 if rule.measure == "clusters" else 2)


def test_rules_on_a_stream_with_late_rows_and_a_restart(spark, folder):
    data = rows(2, 400)
    lost = [(START, 500, 9.0, True, "ERROR", "f0")] * 30  # far behind the watermark when they come
    parts = [data[:150], data[160:300] + data[150:160], data[300:] + lost, [(START + dt.timedelta(days=9), 200, None, False, None, "x")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        streams = {r.measure: jobs.stream_files(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, 1) for r in alerts.RULES[:3:2]}
        alerts.run_rules(streams, f"{folder}/out", f"{folder}/cp", rules=alerts.RULES[:3:2])
    for rule in alerts.RULES[:3:2]:
        written = spark.read.parquet(f"{folder}/out/{rule.measure}/*")
        assert got(written) == plain(data, rule) and written.count() == len(plain(data, rule))


def test_sketch_of_merged_panes(spark):
    data = rows(3, 3000)
    windows = alerts.sliding(alerts.panes(spark.createDataFrame(data, SCHEMA), "ts", 5.0), "1 hour").filter("timed > 200").collect()
    assert windows
    for w in windows:
        held = sorted(r[2] for r in data if w.window.start <= r[0] < w.window.end and r[2] is not None)
        rank = sum(x <= w.p95 for x in held) / len(held)
        assert abs(rank - 0.95) < 0.03 and w.timed == len(held) and w.slow == sum(x > 5 for x in held)


def test_windows_of_other_steps(spark):
    data = rows(4, 200)
    wide = alerts.sliding(alerts.panes(spark.createDataFrame(data, SCHEMA), "ts", 5.0, step="5 minutes"), "10 minutes", "5 minutes")
    assert wide.agg(F.sum("rows")).first()[0] == 400
