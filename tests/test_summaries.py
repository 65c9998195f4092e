"""Day summaries against counting everything."""

import random

from pyspark.sql import functions as F

from lumenlog.operators import summaries as m


def test_merged_days_are_close_to_the_truth(spark, folder):
    rng = random.Random(9)
    rows = [(f"2024-01-{d:02d}", rng.choice("ab"), f"u{rng.randrange(6000)}", rng.gauss(50, 20) if rng.random() < 0.9 else None) for d in range(1, 6) for _ in range(3000)]
    df = spark.createDataFrame(rows + [(None, "a", "x", 1.0)], "d string, k string, u string, v double").withColumn("log_date", F.to_date("d"))
    sketches = {"user": F.col("u")}, {"v": F.col("v")}
    for days in ("d < '2024-01-04'", "d >= '2024-01-03'"):  # the third twice
        m.store(m.summarise(df.filter(days), "log_date", ["k"], {"long": (F.col("v") > 60).cast("int")}, *sketches), folder, "log_date")
    for first, last in ((None, None), ("2024-01-02", "2024-01-04")):
        held = [r for r in rows if (first or "") <= r[0] <= (last or "z")]
        for r in m.merged(spark, folder, ["k"], first, last).select("*", m.estimate("user").alias("users"), m.quantile("v", 0.95).alias("p95"), m.mean("v").alias("mean")).collect():
            own = [x for x in held if x[1] == r["k"]]
            values = sorted(x[3] for x in own if x[3] is not None)
            assert r["rows"] == len(own) and r["long"] == sum(v > 60 for v in values)
            assert abs(r["users"] / len({x[2] for x in own}) - 1) < 0.04
            assert abs(sum(v <= r["p95"] for v in values) / len(values) - 0.95) < 0.02
            assert abs(r["mean"] - sum(values) / len(values)) < 1e-9


def test_a_new_day_reads_only_itself_and_nulls_count_nowhere(spark, folder):
    df = spark.createDataFrame([("2024-01-01", None, None), ("2024-01-01", "x", None), ("2024-01-02", "x", 2.0)], "d string, u string, v double").withColumn("log_date", F.to_date("d"))
    for day in ("2024-01-01", "2024-01-02"):
        m.store(m.summarise(df.filter(F.col("d") == day), "log_date", [], {}, {"u": F.col("u")}, {"v": F.col("v")}), folder, "log_date")
    one = m.merged(spark, folder, []).select("rows", m.estimate("u").alias("u"), m.quantile("v", 0.5).alias("v")).first()
    assert tuple(one) == (3, 1, 2.0)
    first = m.merged(spark, folder, [], last="2024-01-01").select("rows", m.quantile("v", 0.5).alias("v"), m.mean("v").alias("mean")).first()
    assert tuple(first) == (2, None, None)
