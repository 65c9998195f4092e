"""Retries, dead letters and redrives over a stream that is stopped and started again."""

import datetime as dt

from lumenlog.streaming import jobs, retries

START = dt.datetime(2024, 1, 1)


def minute(k):
    return START + dt.timedelta(minutes=k)


def follow(spark, folder, rows, **more):
    spark.createDataFrame(rows, retries.OUTCOMES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.stream_files(spark, f"{folder}/in", spark.createDataFrame([], retries.OUTCOMES).schema, 1)
    retries.run_retries(stream, f"{folder}/queue", f"{folder}/dead", f"{folder}/cp", **more)


def queued(spark, folder):
    return sorted((r.job_id, r.retry_count, r.due) for r in spark.read.parquet(f"{folder}/queue/source=retry").collect())


def test_tries_delays_dead_letters_and_redrive(spark, folder):
    def tick(k):
        return (None, None, None, None, minute(k))

    # a fails three times, b recovers, c fails once, d never fails, e's failures are separated by a success.
    follow(spark, folder, [("a", False, "a1", False, minute(0)), ("b", False, "b1", True, minute(0)), ("d", True, None, False, minute(0)), ("e", False, "e1", False, minute(0)), tick(1.5)])
    assert queued(spark, folder) == []  # the watermark is a minute behind
    follow(spark, folder, [tick(3)])
    first = [("a", 1, minute(1)), ("b", 1, minute(1)), ("e", 1, minute(1))]
    assert queued(spark, folder) == first
    follow(spark, folder, [("a", False, "a2", False, minute(3)), ("b", True, None, True, minute(3)), ("e", True, None, False, minute(3)), tick(5)])
    follow(spark, folder, [("c", False, "c1", False, minute(5)), ("e", False, "e2", False, minute(5)), tick(9)])
    second = [("a", 2, minute(5)), ("c", 1, minute(6)), ("e", 1, minute(6))]
    assert queued(spark, folder) == sorted(first + second)
    follow(spark, folder, [("a", False, "a3", False, minute(9)), tick(30)])
    assert queued(spark, folder) == sorted(first + second)
    letters = retries.dead_letters(spark, f"{folder}/dead").collect()
    assert [(r.job_id, r.tries, r.error, r["at"]) for r in letters] == [("a", 3, "a3", minute(9))]
    for _ in range(2):  # the same redrive again moves nothing twice
        back = retries.redrive(spark, f"{folder}/dead", f"{folder}/queue", 0, to_priority=True).collect()
        assert [(r.job_id, r.retry_count, r.priority) for r in back] == [("a", 0, True)]
        assert retries.dead_letters(spark, f"{folder}/dead").collect() == []
    # It has a fresh budget, and can die again.
    follow(spark, folder, [("a", False, f"again {k}", False, minute(31 + k)) for k in range(3)])
    assert [(r.job_id, r.tries, r.error) for r in retries.dead_letters(spark, f"{folder}/dead").collect()] == [("a", 3, "again 2")]


def test_another_budget_and_several_outcomes_in_one_batch(spark, folder):
    rows = [("x", False, f"x{k}", False, minute(k)) for k in range(5)] + [("y", False, "y0", False, minute(0)), ("y", True, None, False, minute(0))]
    follow(spark, folder, [*rows, (None, None, None, None, minute(60))], most=2, delay_seconds=30)
    letters = {r.job_id: (r.tries, r.error) for r in retries.dead_letters(spark, f"{folder}/dead").collect()}
    assert letters == {"x": (2, "x3")}  # two in a row twice, the later one stays
    assert queued(spark, folder) == [("x", 1, minute(4.5))]
