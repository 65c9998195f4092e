"""Named queries: chat, tools and embedding metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.operators import chat as ch
from lumenlog.plans.registry import query, r, rounded

CHAT_PAYLOAD = """(SELECT *, '{"event_id":"' || event_id || '","event_type":"' || event_type || '","session_id":"' || session_id || '","user_id":"' || user_id || '","timestamp":"' ||
    replace(CAST(event_timestamp AS STRING), ' ', 'T') || 'Z","role":"' || role || '","content":"n ' || event_id || '"' ||
    CASE WHEN total_tokens IS NULL THEN '' ELSE ',"token_usage":{"total_tokens":' || CAST(total_tokens AS STRING) || '}' END || '}' AS payload FROM chat) AS p"""


@query(
    "chat_event_rows",
    """SELECT event_id, event_timestamp, session_id, user_id, event_type, role, '{"text":"n ' || event_id || '"}' AS content, CAST(total_tokens AS BIGINT) AS total_tokens,
       CASE WHEN total_tokens IS NOT NULL THEN CAST(0 AS BIGINT) END AS prompt_tokens FROM chat""",
)
def _(c):
    rows = ch.chat_event_rows(c.sql(f"SELECT payload FROM chat JOIN {CHAT_PAYLOAD} ON chat.event_id = p.event_id"))
    return rows.select("event_id", "event_timestamp", "session_id", "user_id", "event_type", "role", "content", F.col("token_usage.total_tokens").alias("total_tokens"), F.col("token_usage.prompt_tokens").alias("prompt_tokens"))


@query("tool_invocation_rows", "SELECT invocation_id, session_id, user_id, tool_name, started_at, duration_ms, status, bytes_billed, '{\"limit\":' || CAST(limit_arg AS VARCHAR) || '}' AS input_args FROM tool_inv")
def _(c):
    fields = F.to_json(
        F.struct("invocation_id", "session_id", "user_id", "tool_name", F.col("started_at").cast("string").alias("started_at"), "duration_ms", "status", "bytes_billed",
                 F.struct(F.col("limit_arg").alias("limit")).alias("input_args"))
    )
    rows = ch.tool_invocation_rows(c.tool_inv.select(fields.alias("payload")))
    return rows.select("invocation_id", "session_id", "user_id", "tool_name", "started_at", "duration_ms", "status", "bytes_billed", "input_args")


@query(
    "route_events",
    """SELECT event_id, CASE WHEN coalesce(attribute_event_type, json_extract_string(payload, '$.event_type'), 'unknown') = 'tool_invocation' THEN 'tool' ELSE 'chat' END AS route FROM messages""",
)
def _(c):
    tools, chats = ch.route_events(c.messages, "attribute_event_type", "payload")
    return tools.select("event_id", F.lit("tool").alias("route")).unionByName(chats.select("event_id", F.lit("chat").alias("route")))


@query(
    "sessions_summary",
    """SELECT session_id, user_id, min(event_timestamp) AS started_at, max(event_timestamp) AS ended_at, count(*) AS event_count, count(*) FILTER (WHERE event_type = 'message_sent') AS message_count,
       count(*) FILTER (WHERE event_type = 'tool_start') AS tool_count, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS total_tokens FROM chat GROUP BY ALL""",
)
def _(c):
    return ch.sessions_summary(c.chat)


@query(
    "tool_usage",
    f"""SELECT tool_name, count(*) AS invocation_count, count(*) FILTER (WHERE status = 'success') AS success_count, count(*) FILTER (WHERE status = 'failure') AS failure_count,
        {r('avg(duration_ms)')} AS avg_duration_ms, CAST(sum(coalesce(bytes_billed, 0)) AS BIGINT) AS total_bytes_billed, CAST(sum(limit_arg) AS BIGINT) AS total_tokens FROM tool_inv GROUP BY 1""",
)
def _(c):
    return rounded(ch.tool_usage(c.tool_inv.withColumnRenamed("limit_arg", "tokens_used")), "avg_duration_ms")


@query(
    "embeddings_summary",
    f"""SELECT project_id, source_type, CAST(created_at AS DATE) AS created_date, count(*) AS total_embeddings, count(*) FILTER (WHERE status = 'success') AS success_count,
        count(*) FILTER (WHERE status = 'failure') AS failure_count, count(*) FILTER (WHERE status = 'duplicate') AS duplicate_count, {r('avg(processing_time_ms)')} AS avg_processing_time_ms,
        {r('avg(embedding_dim)')} AS embedding_dim FROM embeddings_meta GROUP BY ALL""",
)
def _(c):
    return rounded(ch.embeddings_summary(c.embeddings_meta), "avg_processing_time_ms", "embedding_dim")


CATEGORY = """CASE WHEN regexp_matches(lower(tool_name), 'runbook|repo') THEN 'knowledge' WHEN regexp_matches(lower(tool_name), 'search|find') THEN 'search'
    WHEN regexp_matches(lower(tool_name), 'query|bq') THEN 'query' WHEN regexp_matches(lower(tool_name), 'analyze|summary') THEN 'analysis'
    WHEN regexp_matches(lower(tool_name), 'health|trace') THEN 'monitoring' ELSE 'other' END"""


@query("tool_category", f"SELECT invocation_id, {CATEGORY} AS category FROM tool_inv")
def _(c):
    return c.tool_inv.select("invocation_id", ch.tool_category("tool_name").alias("category"))


@query(
    "tool_cost",
    f"""WITH b AS (SELECT *, CASE tool_name WHEN 'bq_query_tool' THEN 5000 WHEN 'search_logs_tool' THEN 3000 WHEN 'analyze_logs' THEN 4000 WHEN 'trace_lookup_tool' THEN 1500 ELSE 1000 END AS base FROM tool_inv),
        t AS (SELECT *, CASE WHEN status = 'success' THEN CAST(floor(base * (limit_arg / 20.0)) AS BIGINT) END AS token_count FROM b)
        SELECT invocation_id, {CATEGORY} AS category, token_count, {r('CASE WHEN token_count > 0 THEN token_count / 1000.0 * 0.01 END', 6)} AS cost_usd FROM t""",
)
def _(c):
    return rounded(ch.tool_cost(c.tool_inv).select("invocation_id", "category", "token_count", "cost_usd"), "cost_usd", digits=6)


TOKENS = r"CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END + 4"


@query(
    "token_budget",
    f"""WITH t AS (SELECT conv_id, turn, CAST({TOKENS} AS INTEGER) AS tokens FROM conversations), u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_used FROM t)
        SELECT *, 300 - tokens_used AS tokens_remaining, {r('tokens_used / 300.0 * 100', 2)} AS percent_used, tokens_used > 300 AS exceeded, tokens_used >= 240 AS should_summarize FROM u""",
)
def _(c):
    return rounded(ch.token_budget(c.conversations, 300), "percent_used", digits=2)


CALLS = """(SELECT 's-' || CAST(user_id AS STRING) AS session_id, event_type AS tool_name, event_id AS call_id, ts AS event_timestamp, 'tool_start' AS event_type, CAST(NULL AS STRING) AS status FROM events
    UNION ALL SELECT 's-' || CAST(user_id AS STRING), event_type, event_id, ts + CAST(floor(value) AS INT) * INTERVAL '1' SECOND, 'tool_end', CASE WHEN value > 100 THEN 'failure' ELSE 'success' END FROM events WHERE event_type <> 'signup') AS e"""


@query(
    "pair_tool_events",
    f"""SELECT session_id, tool_name, call_id, min(event_timestamp) AS started_at, CASE WHEN count(*) > 1 THEN max(event_timestamp) END AS ended_at,
        CASE WHEN count(*) > 1 THEN CAST(epoch_us(max(event_timestamp)) - epoch_us(min(event_timestamp)) AS BIGINT) // 1000 END AS duration_ms,
        CASE WHEN count(*) = 1 THEN 'running' ELSE coalesce(max(status), 'success') END AS status FROM {CALLS} GROUP BY ALL""",
)
def _(c):
    return ch.pair_tool_events(c.sql(f"SELECT * FROM {CALLS}"))


@query(
    "chat_session_state",
    "SELECT conv_id, substr(arg_min(text, turn), 1, 50) AS title, arg_max(text, turn) AS last_message, arg_max(role, turn) AS last_role, count(*) AS message_count FROM conversations GROUP BY 1",
)
def _(c):
    return ch.chat_session_state(c.conversations)


@query("embed_candidates", "SELECT * FROM conversations WHERE role = 'user' AND coalesce(text, '') <> ''")
def _(c):
    return ch.embed_candidates(c.conversations)


@query(
    "tool_executions",
    f"""WITH g AS (SELECT tool_name, count(*) AS runs, avg(duration_ms) AS a, max(duration_ms) AS max_ms FROM tool_inv GROUP BY 1)
        SELECT tool_name, runs, {r('a')} AS avg_ms, max_ms, CAST(dense_rank() OVER (ORDER BY runs DESC) AS INTEGER) AS use_rank, CAST(dense_rank() OVER (ORDER BY a DESC) AS INTEGER) AS slow_rank FROM g""",
)
def _(c):
    return rounded(ch.tool_executions(c.tool_inv), "avg_ms")


@query(
    "agent_run_rows",
    """SELECT invocation_id AS run_id, started_at AS ts, tool_name AS user_query, '{"session":"' || session_id || '"}' AS scope, '{}' AS graph_state, '{"limit":' || limit_arg || '}' AS tool_calls,
       '{}' AS cost_summary, '{}' AS token_usage, '{"status":"' || status || '"}' AS evidence, '' AS runbook_ids, CAST(0 AS DOUBLE) AS confidence, status, CAST(NULL AS VARCHAR) AS error FROM tool_inv""",
)
def _(c):
    runs = c.tool_inv.select(
        F.col("invocation_id").alias("run_id"), F.col("started_at").alias("ts"), F.col("tool_name").alias("user_query"), F.struct(F.col("session_id").alias("session")).alias("scope"),
        F.struct(F.col("limit_arg").alias("limit")).alias("tool_calls"), F.array(F.struct("status")).alias("evidence"), F.lit(None).cast("array<string>").alias("runbook_ids"),
        F.lit(None).cast("double").alias("confidence"), "status", F.lit(None).cast("string").alias("error"),
    )
    return ch.agent_run_rows(runs).withColumns({"evidence": F.array_join("evidence", ","), "runbook_ids": F.array_join("runbook_ids", ",")})
