"""Retries with a memory: failed work comes back after a delay, and after too many failures it becomes a dead letter.

Outcomes of attempts are a stream. Per key a small state counts the failures since the last success; a timer in event time hands the
key out again when its delay, doubled with every failure, is over. Keys that have used up their tries go to a table of dead letters,
which ``redrive`` empties back into the queue with a fresh budget. State and timers live in the query's checkpoint, so a restarted
query goes on counting where it stopped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenlog.sources import merge_table
from lumenlog.streaming.jobs import run_to_completion

MAX_RETRIES = 3

OUTCOMES = "job_id string, ok boolean, error string, priority boolean, at timestamp"
ACTIONS = "job_id string, action string, tries int, error string, priority boolean, at timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"




def _processor(most: int, delay_seconds: int) -> StatefulProcessor:
    """Counts failures of a key. Gives out ``retry`` when a delay is over, ``dead`` when the tries are used up, ``done`` on success.

    The class is made here, so that it travels to the executors whole and they need no copy of this package.
    """
    epoch, millisecond = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), dt.timedelta(milliseconds=1)

    def millis(at: dt.datetime) -> int:
        return ((at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)) - epoch) // millisecond

    def action(key, name: str, tries: int, error, priority, at: int) -> Row:
        return Row(job_id=key[0], action=name, tries=tries, error=error, priority=priority, at=epoch + at * millisecond)

    class Retries(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("failures", "tries int, error string, priority boolean, due bigint")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            if key[0] is None:
                return  # a tick: it only moves the watermark
            told = [r for r in rows if r["at"] is not None and r["ok"] is not None]
            if not told:
                return
            # The state is read and written once for a batch, however many outcomes it has.
            held = self.state.get() if self.state.exists() else None
            tries, error, priority, due = held or (0, None, None, None)
            waiting = due
            # Outcomes of one batch in the order of their time; equal times: failures first, so that a success stands.
            for r in sorted(told, key=lambda r: (r["at"], r["ok"], r["error"] or "")):
                if r["ok"]:
                    yield action(key, "done", tries, None, r["priority"], millis(r["at"]))
                    tries, due = 0, None
                elif tries + 1 >= most:
                    yield action(key, "dead", tries + 1, r["error"], r["priority"], millis(r["at"]))
                    tries, due = 0, None
                else:
                    due = millis(r["at"]) + delay_seconds * 1000 * 2**tries
                    tries, error, priority = tries + 1, r["error"], r["priority"]
            if waiting is not None and waiting != due:
                self.handle.deleteTimer(waiting)
            if due is not None and due != waiting:
                self.handle.registerTimer(due)
            if tries:
                self.state.update((tries, error, priority, due))
            elif held:
                self.state.clear()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            if self.state.exists():
                tries, error, priority, due = self.state.get()
                if due == expiredTimerInfo.getExpiryTimeInMs():
                    # The key keeps its count until its next outcome; it only waits no more.
                    self.state.update((tries, error, priority, None))
                    yield action(key, "retry", tries, error, priority, due)

        def close(self) -> None:
            pass

    return Retries()


def actions(outcomes: DataFrame, most: int = MAX_RETRIES, delay_seconds: int = 60, lateness: str = "1 minute") -> DataFrame:
    """What to do with each key, from the stream of outcomes (``OUTCOMES``). Rows without a key or a time do nothing but tick."""
    return outcomes.withWatermark("at", lateness).groupBy("job_id").transformWithState(_processor(most, delay_seconds), ACTIONS, "Append", "EventTime")


def run_retries(outcomes: DataFrame, queue: str, dead: str, checkpoint: str, most: int = MAX_RETRIES, delay_seconds: int = 60, lateness: str = "1 minute") -> None:
    """Follow the outcomes: keys to try again go to the folder ``queue``, dead letters to the merge table ``dead``.

    Both are written by batch and a repeated batch writes the same again. State with timers needs the RocksDB store, which is set for
    the time of the run.
    """
    spark = outcomes.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)

    def each(batch: DataFrame, batch_id: int) -> None:
        again = batch.filter("action = 'retry'").select("job_id", F.col("tries").alias("retry_count"), "priority", F.col("at").alias("due"))
        again.write.mode("overwrite").parquet(f"{queue}/source=retry/batch={batch_id}")
        letters = batch.filter("action = 'dead'").groupBy("job_id").agg(F.max_by(F.struct("tries", "error", "priority"), "at").alias("v"), F.max("at").alias("at"))
        merge_table.upsert(letters.select("job_id", "v.*", "at"), dead, "job_id", "at", batch_id, "retries", buckets=16)

    try:
        run_to_completion(actions(outcomes, most, delay_seconds, lateness), each, checkpoint)
    finally:
        spark.conf.set(setting, before)


def dead_letters(spark: SparkSession, dead: str) -> DataFrame:
    return merge_table.read(spark, dead, "job_id", "at")


def redrive(spark: SparkSession, dead: str, queue: str, number: int, to_priority: bool = False, limit: int | None = None) -> DataFrame:
    """Move dead letters (all, or the ``limit`` oldest) back to the queue with a fresh budget; returns them.

    ``number`` counts redrives upwards; the queue gets its folder first and the letters go afterwards, so a redrive that failed in
    between is finished by the same number and moves each letter once.
    """
    path = f"{queue}/source=redrive/batch={number}"
    if number > merge_table.manifest(spark, dead)["applied"].get("redrive", -1):
        letters = dead_letters(spark, dead)
        if limit is not None:
            letters = letters.orderBy("at", "job_id").limit(limit)
        moved = letters.select("job_id", F.lit(0).alias("retry_count"), (F.col("priority") | F.lit(to_priority)).alias("priority"), F.col("at").alias("due"))
        moved.write.mode("overwrite").parquet(path)
        gone = spark.read.parquet(path).select("job_id", F.col("due").alias("at"))
        merge_table.upsert(letters.limit(0), dead, "job_id", "at", number, "redrive", gone)
    return spark.read.parquet(path)
