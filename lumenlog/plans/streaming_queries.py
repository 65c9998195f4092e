"""Named queries: streams, incremental loads and rolling state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.contracts import PAYLOAD_LOG_TYPES
from lumenlog.functions.ordered import rolling_counts, rolling_rows, with_key_position, with_position
from lumenlog.functions.timewin import EVENTS_AS_OF as AS_OF
from lumenlog.operators import normalize as n
from lumenlog.plans.normalize_queries import ALERT_TEXT, PAYLOAD_FIELDS, SEVERITY_LIST
from lumenlog.plans.oracle_views import level_sql, log_type_sql
from lumenlog.plans.registry import query, r, rounded
from lumenlog.plans.shapes import SINK_KINDS, documents, raw_sinks
from lumenlog.plans.text_queries import CHUNKS
from lumenlog.session import scratch_path
from lumenlog.sources import io, merge_table
from lumenlog.streaming import alerts, etl, jobs, retries


def event_stream(c):
    return jobs.stream_files(c.spark, c.path("events"), c.events.schema)


def log_columns(df):
    """Severity and message of an event, as the log adapter derives them."""
    severity = (
        F.when(F.col("event_id") % 307 == 0, "WARN")
        .when((F.col("event_type") == "error") & (F.col("value") >= 100), "CRITICAL")
        .when(F.col("event_type") == "error", "ERROR")
        .when((F.col("event_type") == "purchase") & (F.col("value") >= 100), "WARNING")
        .when(F.col("event_type") == "signup", "NOTICE")
        .when(F.col("event_type") == "view", "DEBUG")
        .otherwise("INFO")
    )
    message = F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))
    return df.select(F.col("event_id").cast("string").alias("log_id"), F.col("ts").cast("timestamp").alias("ts"), severity.alias("severity"), message.alias("message"), "value", "event_type", "user_id")


SEV = """CASE WHEN event_id % 307 = 0 THEN 'WARN' WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' AND value >= 100 THEN 'WARNING'
    WHEN event_type = 'signup' THEN 'NOTICE' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END"""
LOGGED = f"(SELECT CAST(event_id AS VARCHAR) AS log_id, ts, {SEV} AS severity, event_type || ' ' || event_id AS message, value, event_type, user_id FROM events) AS l"


def two_paths(c, label: str) -> tuple[str, str]:
    root = scratch_path(c.spark, label)
    return f"{root}/data", f"{root}/checkpoint"


@query("incremental_extract", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(c):
    path, checkpoint = two_paths(c, "extract")
    stream = event_stream(c).select("event_id", "ts", "user_id", "event_type", "value")
    jobs.append_stream(stream, path, checkpoint)
    jobs.append_stream(stream, path, checkpoint)  # nothing new: the checkpoint remembers
    return jobs.read_batches(c.spark, path, stream.schema).drop("batch")


@query("hourly_lookback", "SELECT log_id, event_timestamp, severity FROM logs WHERE event_timestamp IS NOT NULL")
def _(c):
    rows = c.logs.filter("event_timestamp IS NOT NULL").select("log_id", "event_timestamp", "severity")
    stored = rows.filter(F.col("event_timestamp") < F.lit("2024-01-30 22:30:00").cast("timestamp_ntz"))
    return stored.unionByName(jobs.lookback_rows(rows, stored, "2024-01-30 22:00:00", "event_timestamp", "log_id"))


@query("dedup_within_watermark", "SELECT DISTINCT 'ins-' || CASE WHEN event_id % 50 = 1 THEN event_id - 1 ELSE event_id END AS insert_id FROM events")
def _(c):
    path, checkpoint = two_paths(c, "dedup")
    key = F.when(F.col("event_id") % 50 == 1, F.col("event_id") - 1).otherwise(F.col("event_id"))
    stream = event_stream(c).select(F.concat(F.lit("ins-"), key).alias("insert_id"), F.col("ts").cast("timestamp").alias("ts"))
    jobs.append_stream(jobs.dedup_within_watermark(stream, "ts", ["insert_id"]), path, checkpoint)
    return jobs.read_batches(c.spark, path, stream.schema).select("insert_id")


@query(
    "consume_messages",
    """SELECT CASE WHEN event_id % 5 = 0 OR event_type = 'error' THEN 'tool' ELSE 'chat' END AS route, 'e-' || event_id AS event_id, CASE WHEN event_id % 5 = 0 OR event_type = 'error' THEN NULL ELSE 's-' || user_id END AS session_id,
       CASE WHEN event_id % 5 = 0 OR event_type = 'error' THEN NULL ELSE '{"text":"note ' || event_id || '"}' END AS content FROM events""",
)
def _(c):
    source, _unused = two_paths(c, "messages")
    chats, checkpoint = two_paths(c, "chat-events")
    tools = scratch_path(c.spark, "tool-events")
    wire = c.messages.select("event_id", F.base64(F.encode("payload", "UTF-8")).alias("data"), "attribute_event_type")
    wire.write.parquet(source)
    jobs.consume_messages(jobs.stream_files(c.spark, source, wire.schema), chats, tools, checkpoint)
    chat_rows = c.spark.read.parquet(chats).select(F.lit("chat").alias("route"), "event_id", "session_id", "content")
    null = F.lit(None).cast("string")
    tool_rows = c.spark.read.parquet(tools).select(F.lit("tool").alias("route"), F.concat(F.lit("e-"), "event_id").alias("event_id"), null.alias("session_id"), null.alias("content"))
    return chat_rows.unionByName(tool_rows)


@query("critical_alerts", f"SELECT log_id, ts, severity, message FROM {LOGGED} WHERE severity IN ('CRITICAL', 'ALERT')")
def _(c):
    path, checkpoint = two_paths(c, "alerts")
    stream = jobs.critical_alerts(log_columns(event_stream(c))).select("log_id", "ts", "severity", "message")
    jobs.append_stream(stream, path, checkpoint)
    return jobs.read_batches(c.spark, path, stream.schema).drop("batch")


@query("stream_route_by_severity", f"SELECT 'analytics' AS route, count(*) AS n FROM {LOGGED} WHERE {level_sql('severity')} >= 200 UNION ALL SELECT 'archive', count(*) FROM {LOGGED} WHERE {level_sql('severity')} >= 200 UNION ALL SELECT 'alerts', count(*) FROM {LOGGED} WHERE {level_sql('severity')} >= 500")
def _(c):
    root, checkpoint = two_paths(c, "routes")
    paths = {name: f"{root}/{name}" for name in ("analytics", "archive", "alerts")}
    jobs.route_by_severity(log_columns(event_stream(c)), paths, checkpoint, n.severity_level("severity"))
    parts = [c.spark.read.parquet(p).agg(F.lit(name).alias("route"), F.count("*").alias("n")) for name, p in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ERRORS = "count(*) FILTER (WHERE severity IN ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY'))"


@query(
    "windowed_rates",
    f"""SELECT date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end, count(*) AS entries, {ERRORS} AS errors, CAST(sum(strlen(message)) AS BIGINT) AS bytes,
        {ERRORS} > 0 AS fired FROM {LOGGED} GROUP BY 1, 2""",
)
def _(c):
    path, checkpoint = two_paths(c, "rates")
    stream = jobs.windowed_rates(log_columns(event_stream(c)), "ts", "60 seconds", delay="40 days")
    jobs.run_windowed(stream, path, checkpoint)
    return jobs.fired(jobs.latest_updates(c.spark, path, stream.schema, ["window_start", "window_end"]), "errors", 0)


@query(
    "sliding_alerts",
    f"""WITH w AS (SELECT l.*, date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS s FROM {LOGGED}, (SELECT unnest(range(10)) AS k))
        SELECT s AS window_start, s + INTERVAL 10 MINUTE AS window_end, count(*) AS entries, {ERRORS} AS errors, CAST(sum(strlen(message)) AS BIGINT) AS bytes, {ERRORS} > 5 AS fired FROM w GROUP BY 1, 2""",
)
def _(c):
    return jobs.fired(jobs.windowed_rates(log_columns(c.events), "ts", "10 minutes", "1 minute"), "errors", 5)


# Two seconds apart, so that windows hold enough rows for the rules to fire at any size of the table.
ALERT_ROWS = """SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + event_id * INTERVAL '2' SECOND AS ts, CASE WHEN event_type = 'click' AND value > 40 THEN 503 ELSE 200 END AS status,
    CASE WHEN event_type = 'click' THEN value / 30 END AS latency_s, event_type = 'purchase' AND value > 120 AS denied, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
    'f-' || CAST(user_id % 9 AS STRING) AS fingerprint FROM events"""


def _alert_windows(minutes: int, what: str, where: str = "true", by: str = "") -> str:
    return f"""SELECT date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start, date_trunc('minute', ts) + ({minutes} - k) * INTERVAL 1 MINUTE AS window_end, {what}
        FROM alert_rows, (SELECT unnest(range({minutes})) AS k) WHERE {where} GROUP BY 1, 2{by}"""


@query(
    "alert_rules_stream",
    f"""WITH alert_rows AS ({ALERT_ROWS.replace("AS STRING", "AS VARCHAR")})
        SELECT '5xx Rate Alert' AS rule, window_start, window_end, CAST(n AS DOUBLE) AS value, n > 10 AS fired FROM ({_alert_windows(5, "count(*) FILTER (WHERE status >= 500) AS n")})
        UNION ALL SELECT 'Latency P95 Alert', window_start, window_end, slow / n, p95 > 5 FROM ({_alert_windows(60, "count(*) FILTER (WHERE latency_s > 5) AS slow, count(*) AS n, quantile_disc(latency_s, 0.95) AS p95", "latency_s IS NOT NULL")})
        UNION ALL SELECT 'Error Cluster Growth', window_start, window_end, CAST(count(*) AS DOUBLE), true FROM ({_alert_windows(10, "fingerprint, count(*) AS n", "severity = 'ERROR'", ", fingerprint")}) WHERE n > 5 GROUP BY 1, 2, 3
        UNION ALL SELECT 'Audit Anomalies', window_start, window_end, CAST(n AS DOUBLE), n > 5 FROM ({_alert_windows(60, "count(*) FILTER (WHERE denied) AS n")})""",
)
def _(c):
    """The rules over a stream that is stopped and goes on, with late rows; a heartbeat at the end closes the last windows."""
    source, checkpoint = two_paths(c, "alert-rows")
    out = scratch_path(c.spark, "alert-windows")
    rows = c.sql(ALERT_ROWS).withColumn("ts", F.col("ts").cast("timestamp"))
    # Every fiftieth row comes up to ten minutes late; the watermark waits for a quarter of an hour.
    half = rows.agg(F.max("event_id")).first()[0] / 2
    late = F.when(F.col("event_id") % 50 == 7, 300).otherwise(0)
    parts = [rows.filter(F.col("event_id") + late < half), rows.filter(F.col("event_id") + late >= half)]
    parts[1] = parts[1].unionByName(rows.limit(1).withColumn("ts", F.lit("2100-01-01").cast("timestamp")))
    for k, part in enumerate(parts):
        part.drop("event_id").write.parquet(f"{source}/part={k}")
        alerts.run_rules({rule.measure: jobs.stream_files(c.spark, f"{source}/part=*", rows.drop("event_id").schema) for rule in alerts.RULES}, out, checkpoint)
    return c.spark.read.schema(ALERT_WINDOWS).parquet(f"{out}/*/*")


ALERT_WINDOWS = "rule string, window_start timestamp, window_end timestamp, value double, fired boolean"


@query("dual_write", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text, count(*) AS logged FROM conversations GROUP BY 1")
def _(c):
    state, checkpoint = two_paths(c, "state")
    log = scratch_path(c.spark, "event-log")
    streams = [jobs.stream_files(c.spark, c.path("conversations"), c.conversations.schema) for _ in range(2)]
    jobs.dual_write(*streams, state, log, checkpoint, "conv_id", "turn")
    logged = c.spark.read.parquet(log).groupBy("conv_id").agg(F.count("*").alias("logged"))
    return merge_table.read(c.spark, state, "conv_id", "turn").join(logged, "conv_id")


@query(
    "rolling_latency",
    f"""WITH w AS (SELECT event_id, event_type, avg(value) OVER x AS a, min(value) OVER x AS lo, max(value) OVER x AS hi, count(*) OVER x AS samples FROM events
        WINDOW x AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT event_id, event_type, {r('a', 9)} AS avg_ms, lo AS min_ms, hi AS max_ms, samples FROM w""",
)
def _(c):
    placed = with_key_position(c.events.select("event_id", "ts", "event_type", "value"), ["event_type"], [F.col("ts"), F.col("event_id")])
    stats = {"avg_ms": F.avg("value"), "min_ms": F.min("value"), "max_ms": F.max("value"), "samples": F.count("*")}
    rows = rolling_rows(placed, ["event_type"], "position", 100, stats)
    return rounded(rows.select("event_id", "event_type", *stats), "avg_ms", digits=9)


@query(
    "rolling_errors",
    """SELECT event_id, user_id, count(*) OVER (PARTITION BY 'svc-' || user_id % 5 ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS errors FROM events WHERE event_type = 'error'""",
)
def _(c):
    rows = c.events.filter("event_type = 'error'").select("event_id", "user_id", "ts", F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("service"))
    return rolling_counts(rows, ["service"], "ts", 300, "errors").select("event_id", "user_id", "errors")


@query(
    "dead_letter",
    """SELECT job_id, CAST(retry_count + 1 AS INTEGER) AS retry_count, CASE WHEN retry_count + 1 < 3 THEN 'queue' ELSE 'dead' END AS target FROM etl_jobs WHERE status = 'FAILED'""",
)
def _(c):
    again, dead = jobs.split_retries(c.etl_jobs)
    pick = ["job_id", "retry_count"]
    return again.select(*pick, F.lit("queue").alias("target")).unionByName(dead.select(*pick, F.lit("dead").alias("target")))


@query("redrive", "SELECT job_id, CAST(0 AS INTEGER) AS retry_count, true AS priority, 'QUEUED' AS status FROM etl_jobs WHERE status = 'FAILED' AND retry_count + 1 >= 3")
def _(c):
    return jobs.redrive(jobs.split_retries(c.etl_jobs)[1], to_priority=True).select("job_id", "retry_count", "priority", "status")


# Attempts of a job in the order of its user's events; clicks and purchases go well.
OUTCOMES = "SELECT 'job-' || CAST(user_id AS STRING) AS job_id, event_type IN ('click', 'purchase') AS ok, event_type || ' ' || CAST(event_id AS STRING) AS error, user_id % 2 = 0 AS priority, ts AS tried_at FROM events"
# Failures are counted from the last success on, and every third one in a row uses up the tries.
TRIED = f"""WITH o AS ({OUTCOMES.replace("AS STRING", "AS VARCHAR")}), i AS (SELECT *, count(*) FILTER (WHERE ok) OVER p AS island, row_number() OVER (PARTITION BY job_id ORDER BY tried_at DESC, ok DESC, error DESC) AS back FROM o WINDOW p AS (PARTITION BY job_id ORDER BY tried_at, ok, error ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY job_id, island ORDER BY tried_at, ok, error ROWS UNBOUNDED PRECEDING) AS n FROM i)"""


def followed(c, label: str) -> tuple[str, str]:
    """(queue, dead letters) after following the outcomes; a tick far ahead ends all delays."""
    source, checkpoint = two_paths(c, label)
    queue, dead = two_paths(c, f"{label}-out")
    rows = c.sql(OUTCOMES).withColumn("at", F.col("tried_at").cast("timestamp")).drop("tried_at")
    null = [F.lit(None).cast(t).alias(n) for n, t in rows.dtypes if n != "at"]
    rows.write.parquet(f"{source}/part=0")
    schema = rows.schema
    retries.run_retries(jobs.stream_files(c.spark, f"{source}/part=*", schema), queue, dead, checkpoint)
    rows.limit(1).select(*null, F.lit("2100-01-01").cast("timestamp").alias("at")).select(*rows.columns).write.parquet(f"{source}/part=1")
    retries.run_retries(jobs.stream_files(c.spark, f"{source}/part=*", schema), queue, dead, checkpoint)
    return queue, dead


@query(
    "retry_queue",
    f"""{TRIED} SELECT job_id, CAST(n % 3 AS INTEGER) AS retry_count, priority, epoch_us(tried_at) // 1000 + 60000 * CASE n % 3 WHEN 1 THEN 1 ELSE 2 END AS due FROM t WHERE back = 1 AND NOT ok AND n % 3 <> 0""",
)
def _(c):
    queue, _dead = followed(c, "retry")
    return c.spark.read.parquet(queue).select("job_id", "retry_count", "priority", F.unix_millis("due").alias("due"))


@query(
    "redrive_letters",
    f"""{TRIED}, d AS (SELECT job_id, max(epoch_us(tried_at) // 1000) AS died FROM t WHERE NOT ok AND n % 3 = 0 GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY died, job_id) AS r FROM d)
        SELECT job_id, CASE WHEN r <= 20 THEN 'queued' ELSE 'dead' END AS place, CAST(CASE WHEN r <= 20 THEN 0 ELSE 3 END AS INTEGER) AS tries FROM k""",
)
def _(c):
    queue, dead = followed(c, "redrive")
    for _again in range(2):
        retries.redrive(c.spark, dead, queue, 0, to_priority=True, limit=20)
    queued = c.spark.read.parquet(f"{queue}/source=redrive").select("job_id", F.lit("queued").alias("place"), F.col("retry_count").alias("tries"))
    return queued.unionByName(retries.dead_letters(c.spark, dead).select("job_id", F.lit("dead").alias("place"), "tries"))


PENDING = "status IN ('RUNNING', 'QUEUED', 'PARTIAL')"


@query(
    "queue_stats",
    f"SELECT count(*) FILTER (WHERE {PENDING} AND priority) AS priority, count(*) FILTER (WHERE {PENDING} AND NOT priority) AS backlog, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE {PENDING}) AS total_pending FROM etl_jobs",
)
def _(c):
    return jobs.queue_stats(c.etl_jobs)


@query(
    "priority_batches",
    "SELECT job_id, priority, (row_number() OVER (ORDER BY priority DESC, started_at, seq) - 1) // 100 AS batch_no, row_number() OVER (ORDER BY priority DESC, started_at, seq) - 1 AS position FROM etl_jobs",
)
def _(c):
    placed = with_position(c.etl_jobs, [F.desc("priority"), F.col("started_at"), F.col("seq")])
    return placed.select("job_id", "priority", F.floor(F.col("position") / 100).alias("batch_no"), "position")


@query("tail_stream", f"SELECT log_id, ts, severity, message FROM {LOGGED} WHERE severity = 'WARNING' AND contains(message, '1')")
def _(c):
    path, checkpoint = two_paths(c, "tail")
    stream = log_columns(event_stream(c)).filter((F.col("severity") == "WARNING") & F.col("message").contains("1")).select("log_id", "ts", "severity", "message")
    jobs.append_stream(stream, path, checkpoint)
    return jobs.read_batches(c.spark, path, stream.schema).drop("batch")


@query(
    "global_progress",
    """WITH p AS (SELECT stream_id, arg_max(seq, (started_at, seq)) AS last_offset, CAST(sum(total_loaded) AS BIGINT) AS total_loaded, arg_max(status, (started_at, seq)) AS last_status FROM etl_jobs GROUP BY 1)
       SELECT * FROM p UNION ALL SELECT NULL, max(last_offset), CAST(sum(total_loaded) AS BIGINT), count(*) FILTER (WHERE last_status = 'COMPLETED') || ' sources completed' FROM p""",
)
def _(c):
    return jobs.global_progress(c.etl_jobs)


DROPPED = "doc_id % 7 = 3"
CHANGED = r"(SELECT doc_id, source, regexp_replace(CASE WHEN doc_id % 7 = 2 THEN text || ' ' || text ELSE text END, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE doc_id % 7 <> 3) AS changed"


@query(
    "embed_documents",
    CHUNKS.replace("FROM documents", f"FROM {CHANGED}")
    + r""" SELECT source, sha256(chunk_text) AS text_hash, chunk_id, CAST(64 AS INTEGER) AS dim FROM chunk_rows JOIN (SELECT doc_id AS d, source FROM documents) AS x ON d = doc_id
        WHERE regexp_matches(chunk_text, '[\p{L}\p{N}_]')""",
)
def _(c):
    """Documents are stored, then some are doubled, some cut short and some deleted."""
    target = scratch_path(c.spark, "points")
    docs = documents(c).select("doc_id", "source", "text")
    doubled = docs.filter("doc_id % 7 IN (1, 2, 3)").withColumn("text", F.concat("text", F.lit(" "), "text"))
    etl.embed_documents(docs.filter("doc_id % 7 NOT IN (1, 2, 3)").unionByName(doubled), target, 0)
    again = docs.filter("doc_id % 7 = 1")
    for batch in (1, 1, 2):  # a repeated batch and an unchanged one
        etl.embed_documents(again, target, batch, deleted=docs.filter(DROPPED).select("doc_id"))
    merge_table.compact(c.spark, target, "chunk_id", "version")
    return etl.documents_table(c.spark, target).select("source", "text_hash", "chunk_id", F.size("embedding").alias("dim"))


@query(
    "ingest_logs",
    f"""SELECT service_name AS source, count(*) AS points FROM logs WHERE event_timestamp IS NOT NULL AND service_name IS NOT NULL AND severity IN ({SEVERITY_LIST})
        AND {log_type_sql('source_table')} IN ({", ".join(repr(x) for x in PAYLOAD_LOG_TYPES)}) AND length(message) <= 10000 GROUP BY 1""",
)
def _(c):
    target, quarantine = two_paths(c, "log-points")
    payload = c.logs.select(
        "log_id", F.concat(F.lit("tenant-"), F.expr("right(log_id, 1)")).alias("tenant_id"), "service_name", "severity", n.log_type("source_table").alias("log_type"),
        F.col("event_timestamp").alias("timestamp"), "source_table", "message",
    )
    etl.ingest_logs(payload, target, quarantine, 0, [*PAYLOAD_FIELDS, "body"], PAYLOAD_FIELDS[:-1])
    return etl.documents_table(c.spark, target).groupBy("source").agg(F.count("*").alias("points"))


@query("realtime_error_embeddings", f"SELECT log_id, alert_text, CAST(64 AS INTEGER) AS dim FROM ({ALERT_TEXT}) AS a")
def _(c):
    source, _unused = two_paths(c, "records")
    path, checkpoint = two_paths(c, "error-vectors")
    c.records.write.parquet(source)
    jobs.error_embeddings(jobs.stream_files(c.spark, source, c.spark.read.parquet(source).schema), path, checkpoint, 64)
    schema = T.StructType().add("log_id", "string").add("alert_text", "string").add("embedding", T.ArrayType(T.FloatType()))
    return jobs.read_batches(c.spark, path, schema).select("log_id", "alert_text", F.size("embedding").alias("dim"))


KIND_OF = "(VALUES " + ", ".join(f"('{name}', '{kind}')" for name, kind in SINK_KINDS.items()) + ") AS k(sink, kind)"


RECENT, OLD = "TIMESTAMP '2024-01-25 00:00:00'", "TIMESTAMP '2024-01-11 00:00:00'"


@query(
    "full_and_incremental_load",
    f"""WITH n AS (SELECT sink, count(*) AS n, count(*) FILTER (WHERE ts >= {RECENT}) AS recent, count(*) FILTER (WHERE ts < {OLD}) AS old FROM raw_flat JOIN {KIND_OF} ON sink_kind = kind GROUP BY 1),
        j AS (SELECT 0 AS run, 'incremental' AS mode, sink, 'COMPLETED' AS status, recent AS extracted, recent AS loaded FROM n
            UNION ALL SELECT 1, 'stream', sink, 'COMPLETED', n, n - recent FROM n WHERE sink = 'requests'
            UNION ALL SELECT 2, 'full', sink, 'COMPLETED', n, CASE WHEN sink = 'requests' THEN 0 ELSE n - recent END FROM n
            UNION ALL SELECT 2, 'full', 'gone', 'FAILED', NULL, NULL UNION ALL SELECT 3, 'cleanup', sink, 'COMPLETED', old, 0 FROM n)
        SELECT CAST(run AS INTEGER) AS run, mode, 'logs_v1.' || sink AS stream_id, status, extracted, loaded FROM j
        UNION ALL SELECT CAST(run AS INTEGER), mode, NULL, CASE WHEN run = 2 THEN 'PARTIAL' ELSE 'COMPLETED' END, CAST(sum(extracted) AS BIGINT), CAST(sum(loaded) AS BIGINT) FROM j GROUP BY run, mode""",
)
def _(c):
    """The four modes, one after the other; a sink is missing in the full load."""
    target, job_table = two_paths(c, "unified-load")
    sinks = {name: lambda df=df: df for name, df in raw_sinks(c).items()}
    gone = {"gone": lambda: c.spark.read.parquet(f"{target}/no-such-sink")}
    for run, (mode, more) in enumerate((("incremental", {}), ("stream", {"only": ["requests"]}), ("full", {}), ("cleanup", {"days": 20}))):
        etl.run_load(c.spark, sinks | (gone if mode == "full" else {}), "logs_v1", target, job_table, run, "2024-01-31 00:00:00", mode, hours=144, **more)
    return etl.job_rows(c.spark, job_table).select("run", "mode", "stream_id", "status", "extracted", "loaded")


@query("cleanup_after_load", "SELECT stream_id, count(*) AS kept FROM logs WHERE event_timestamp IS NULL OR event_timestamp >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def _(c):
    path = scratch_path(c.spark, "loaded")
    c.logs.select("log_id", "event_timestamp", "stream_id", "log_date").write.partitionBy("log_date").parquet(path)
    io.cleanup(c.spark, path, "2024-01-10 00:00:00", "log_date")
    return c.spark.read.parquet(path).groupBy("stream_id").agg(F.count("*").alias("kept"))
