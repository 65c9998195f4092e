"""Chat events, tool invocations and embedding metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.contracts import DEFAULT_TOOL_TOKENS, TOOL_LIMIT_BASELINE, TOOL_TOKENS, USD_PER_1000_TOKENS
from lumenlog.functions.columns import col, count_if
from lumenlog.functions.ordered import running_sum

_EVENT_FIELDS = (
    "event_id string, event_type string, session_id string, user_id string, timestamp string, role string, content string, metadata string, "
    "token_usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>, client_info string"
)
_TOOL_FIELDS = (
    "invocation_id string, session_id string, user_id string, tool_name string, started_at string, ended_at string, duration_ms bigint, "
    "status string, input_args string, output_summary string, error_message string, bytes_billed bigint, tokens_used bigint"
)


def _filled(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def chat_event_rows(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed chat events out of JSON payloads; content is wrapped, missing token counts are zero."""
    p = df.select(F.from_json(payload, _EVENT_FIELDS).alias("p")).select("p.*")
    usage = F.when(
        F.col("token_usage").isNotNull(),
        F.struct(*[F.coalesce(f"token_usage.{k}", F.lit(0)).alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")]),
    )
    return p.select(
        "event_id",
        F.try_to_timestamp("timestamp").alias("event_timestamp"),
        "session_id",
        "user_id",
        "event_type",
        "role",
        F.when(_filled(F.col("content")).isNotNull(), F.to_json(F.struct(F.col("content").alias("text")))).alias("content"),
        _filled(F.col("metadata")).alias("metadata"),
        usage.alias("token_usage"),
        _filled(F.col("client_info")).alias("client_info"),
    )


def tool_invocation_rows(df: DataFrame, payload: str = "payload") -> DataFrame:
    p = df.select(F.from_json(payload, _TOOL_FIELDS).alias("p")).select("p.*")
    return p.withColumns(
        {
            "started_at": F.try_to_timestamp("started_at"),
            "ended_at": F.try_to_timestamp(_filled(F.col("ended_at"))),
            "input_args": _filled(F.col("input_args")),
        }
    )


def event_kind(attribute: str | Column, payload: str | Column) -> Column:
    """The message attribute wins over the payload's own event type."""
    return F.coalesce(col(attribute), F.get_json_object(col(payload), "$.event_type"), F.lit("unknown"))


def route_events(df: DataFrame, attribute: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(tool invocations, everything else)"""
    tool = event_kind(attribute, payload) == "tool_invocation"
    return df.filter(tool), df.filter(~tool)


def sessions_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "user_id").agg(
        F.min("event_timestamp").alias("started_at"),
        F.max("event_timestamp").alias("ended_at"),
        F.count("*").alias("event_count"),
        count_if(F.col("event_type") == "message_sent").alias("message_count"),
        count_if(F.col("event_type") == "tool_start").alias("tool_count"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
    )


def tool_usage(tools: DataFrame) -> DataFrame:
    return tools.groupBy("tool_name").agg(
        F.count("*").alias("invocation_count"),
        count_if(F.col("status") == "success").alias("success_count"),
        count_if(F.col("status") == "failure").alias("failure_count"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.sum(F.coalesce("bytes_billed", F.lit(0))).alias("total_bytes_billed"),
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("total_tokens"),
    )


def embeddings_summary(meta: DataFrame) -> DataFrame:
    return meta.groupBy("project_id", "source_type", F.to_date("created_at").alias("created_date")).agg(
        F.count("*").alias("total_embeddings"),
        *[count_if(F.col("status") == s).alias(f"{s}_count") for s in ("success", "failure", "duplicate")],
        F.avg("processing_time_ms").alias("avg_processing_time_ms"),
        F.avg("embedding_dim").alias("embedding_dim"),
    )


def tool_category(name: str | Column) -> Column:
    lowered = F.lower(col(name))
    rules = [("runbook|repo", "knowledge"), ("search|find", "search"), ("query|bq", "query"), ("analyze|summary", "analysis"), ("health|trace", "monitoring")]
    out = F.when(lowered.rlike(rules[0][0]), rules[0][1])
    for words, category in rules[1:]:
        out = out.when(lowered.rlike(words), category)
    return out.otherwise("other")


def tool_cost(tools: DataFrame, limit: str = "limit_arg") -> DataFrame:
    """Token estimate of a tool's output, scaled by its result limit, and what that costs; only successes count."""
    base = F.coalesce(F.create_map(*[F.lit(x) for pair in TOOL_TOKENS.items() for x in pair])[F.col("tool_name")], F.lit(DEFAULT_TOOL_TOKENS))
    scaled = F.floor(base * (F.col(limit) / F.lit(TOOL_LIMIT_BASELINE)))
    tokens = F.when(F.col("status") == "success", F.coalesce(scaled, base.cast("bigint")))
    return tools.withColumns(
        {
            "category": tool_category("tool_name"),
            "token_count": tokens,
            "cost_usd": F.when(tokens > 0, tokens / 1000 * USD_PER_1000_TOKENS),
        }
    )


def word_tokens(text: str | Column) -> Column:
    """Whitespace tokens of a text."""
    trimmed = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def token_budget(messages: DataFrame, max_tokens: int, threshold: float = 0.8, session: str = "conv_id", position: str = "turn") -> DataFrame:
    """Running token use of each conversation (four tokens of overhead per message) against a budget."""
    counted = messages.withColumn("tokens", word_tokens("text") + F.lit(4))
    used = running_sum(counted, [session], position, "tokens", "tokens_used")
    total = F.col("tokens_used")
    return used.select(
        session,
        position,
        "tokens",
        "tokens_used",
        (F.lit(max_tokens) - total).alias("tokens_remaining"),
        (total / F.lit(max_tokens) * 100).alias("percent_used"),
        (total > max_tokens).alias("exceeded"),
        (total >= threshold * max_tokens).alias("should_summarize"),
    )


def pair_tool_events(events: DataFrame) -> DataFrame:
    """Start and end events of the same call as one row with its duration; a call that never ended is running.

    Grouping by (session, tool, call) instead of looking ahead in a window keeps a very long session spread out.
    """
    at = F.col("event_timestamp")
    start, end = F.col("event_type") == "tool_start", F.col("event_type") == "tool_end"
    calls = events.filter(start | end).groupBy("session_id", "tool_name", "call_id").agg(
        F.min(F.when(start, at)).alias("started_at"), F.max(F.when(end, at)).alias("ended_at"), F.max(F.when(end, F.col("status"))).alias("status")
    )
    took = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    return calls.withColumns({"duration_ms": F.floor(took), "status": F.when(F.col("ended_at").isNull(), "running").otherwise(F.coalesce("status", F.lit("success")))})


def chat_session_state(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Title (start of the first message), latest message, last role and length of each conversation."""
    return messages.groupBy(session).agg(
        F.substring(F.min_by("text", order), 1, 50).alias("title"),
        F.max_by("text", order).alias("last_message"),
        F.max_by("role", order).alias("last_role"),
        F.count("*").alias("message_count"),
    )


def embed_candidates(messages: DataFrame) -> DataFrame:
    """User messages that have content."""
    return messages.filter((F.col("role") == "user") & (F.coalesce("text", F.lit("")) != ""))


def tool_executions(tools: DataFrame) -> DataFrame:
    """Tools with their rank by use and by mean duration; ranked after aggregation, so few rows."""
    grouped = tools.groupBy("tool_name").agg(F.count("*").alias("runs"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
    return grouped.withColumns(
        {
            "use_rank": F.dense_rank().over(Window.orderBy(F.desc("runs"))),
            "slow_rank": F.dense_rank().over(Window.orderBy(F.desc("avg_ms"))),
        }
    )


def agent_run_rows(df: DataFrame) -> DataFrame:
    """Run records: nested parts as JSON text ('{}' where missing), evidence as an array of JSON texts."""

    def as_json(column: str) -> Column:
        return F.coalesce(F.to_json(column), F.lit("{}")) if column in df.columns else F.lit("{}")

    return df.select(
        "run_id",
        "ts",
        "user_query",
        *[as_json(c).alias(c) for c in ("scope", "graph_state", "tool_calls", "cost_summary", "token_usage")],
        F.coalesce(F.transform("evidence", lambda e: F.to_json(e)), F.array().cast("array<string>")).alias("evidence"),
        F.coalesce("runbook_ids", F.array().cast("array<string>")).alias("runbook_ids"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "status",
        "error",
    )
