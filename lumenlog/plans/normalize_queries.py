"""Named queries: row normalisation and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.contracts import PAYLOAD_LOG_TYPES, PII_KEYWORDS_HIGH, PII_KEYWORDS_LOW, PII_KEYWORDS_MODERATE
from lumenlog.functions import text
from lumenlog.functions.columns import first_present
from lumenlog.operators import normalize as n
from lumenlog.plans.oracle_views import (
    SEVERITY_LIST,
    any_word,
    category_sql,
    environment_sql,
    error_sql,
    js,
    level_sql,
    log_type_sql,
    pii_sql,
    present,
)
from lumenlog.plans.registry import query
from lumenlog.plans.shapes import documents, enveloped, normalized, unified

MAP = "map<string,string>"


@query("log_type", f"SELECT log_id, {log_type_sql('source_table')} AS log_type FROM logs")
def _(c):
    return c.logs.select("log_id", n.log_type("source_table").alias("log_type"))


@query("severity_level", f"SELECT log_id, {level_sql('severity')} AS severity_level FROM logs")
def _(c):
    return c.logs.select("log_id", n.severity_level("severity").alias("severity_level"))


@query(
    "resource_fields",
    f"""SELECT log_id, {js('resource_labels', 'project_id')} AS resource_project,
    {present(js('resource_labels', 'location'), js('resource_labels', 'region'), js('resource_labels', 'zone'))} AS resource_location,
    {present(js('resource_labels', 'service_name'), js('resource_labels', 'job_name'))} AS resource_name,
    {present(js('resource_labels', 'service_name'), js('resource_labels', 'job_name'), 'resource_type', "'unknown'")} AS service_name,
    {js('resource_labels', 'revision_name')} AS service_version FROM records""",
)
def _(c):
    parsed = c.records.withColumn("_l", F.from_json("resource_labels", MAP))
    return parsed.select("log_id", *[v.alias(k) for k, v in n.resource_fields(F.col("_l"), "resource_type").items()])


@query(
    "payload_fields",
    """SELECT log_id, severity, text_payload, service_name, service_method, caller_ip, caller_network, principal_email, principal_type,
       error_code, payload_error AS error_message FROM o_payload""",
)
def _(c):
    return n.payload_columns(n.parse_record(c.records)).select(
        "log_id", "severity", "text_payload", "service_name", "service_method", "caller_ip", "caller_network", "principal_email",
        "principal_type", "error_code", "error_message",
    )


@query(
    "json_payload_fields",
    f"""SELECT log_id, CASE WHEN upper({js('json_payload', 'level')}) IN ({SEVERITY_LIST}) THEN upper({js('json_payload', 'level')}) ELSE severity END AS severity,
        {js('json_payload', 'message')} AS text_payload, {js('json_payload', 'error')} AS error_message FROM logs_rich""",
)
def _(c):
    level = F.upper(F.get_json_object("json_payload", "$.level"))
    return c.logs_rich.select(
        "log_id",
        F.when(level.isin(n.SEVERITIES), level).otherwise(F.col("severity")).alias("severity"),
        n.json_field("json_payload", "message").alias("text_payload"),
        n.json_field("json_payload", "error").alias("error_message"),
    )


@query(
    "audit_payload_fields",
    f"""SELECT log_id, {js('audit_payload', 'methodName')} AS service_method, {js('audit_payload', 'serviceName')} AS service_name,
        {js('audit_payload', 'status.code')} AS error_code, {js('audit_payload', 'status.message')} AS error_message FROM logs_rich""",
)
def _(c):
    parsed = c.logs_rich.withColumn("_a", F.from_json("audit_payload", n._AUDIT_FIELDS))
    return parsed.select(
        "log_id",
        F.col("_a.methodName").alias("service_method"),
        F.col("_a.serviceName").alias("service_name"),
        F.col("_a.status.code").alias("error_code"),
        F.col("_a.status.message").alias("error_message"),
    )


@query(
    "http_fields",
    """SELECT log_id, http_method, http_url, http_status, http_latency_ms, http_user_agent, http_remote_ip, http_request_size, http_response_size
       FROM o_payload WHERE http_request IS NOT NULL""",
)
def _(c):
    rows = n.context_columns(n.parse_record(c.records.filter(F.col("http_request").isNotNull())))
    return rows.select(
        "log_id", "http_method", "http_url", "http_status", "http_latency_ms", "http_user_agent", "http_remote_ip", "http_request_size", "http_response_size"
    )


@query("latency_text", "SELECT log_id, TRY_CAST(rtrim(http_latency_text, 's') AS DOUBLE) * 1000 AS http_latency_ms FROM logs_rich")
def _(c):
    return c.logs_rich.select("log_id", n.latency_ms("http_latency_text").alias("http_latency_ms"))


@query("trace_fields", "SELECT log_id, list_extract(string_split(trace_id, '/'), -1) AS trace_id, span_id FROM logs")
def _(c):
    return c.logs.select("log_id", n.last_segment("trace_id").alias("trace_id"), "span_id")


@query(
    "operation_and_source_fields",
    """SELECT log_id, operation_id, operation_producer, operation_first, operation_last, source_file, source_line, source_function FROM o_payload""",
)
def _(c):
    return n.context_columns(n.parse_record(c.records)).select(
        "log_id", "operation_id", "operation_producer", "operation_first", "operation_last", "source_file", "source_line", "source_function"
    )


@query(
    "detect_error",
    f"""SELECT doc_id, {error_sql('text')} AS error_message,
        CASE WHEN contains(text, 'Traceback') OR contains(text, 'at ') THEN text END AS error_stack_trace FROM documents""",
)
def _(c):
    return documents(c).select("doc_id", text.error_in_text("text").alias("error_message"), text.stack_trace("text").alias("error_stack_trace"))


@query("build_message", "SELECT log_id, message FROM o_normal")
def _(c):
    return normalized(c).select("log_id", "message")


@query(
    "log_flags",
    f"""SELECT log_id, {level_sql('severity')} >= 500 AS is_error, contains(lower(source_table), 'audit') AS is_audit,
        contains(lower(source_table), 'request') AS is_request, coalesce(trace_id, '') <> '' AS has_trace FROM logs""",
)
def _(c):
    return c.logs.select("log_id", *[v.alias(k) for k, v in n.flags("source_table", n.severity_level("severity"), "trace_id").items()])


@query("environment", f"SELECT log_id, {environment_sql('service_name', js('labels', 'env'), js('labels', 'environment'), js('resource_labels', 'env'), js('resource_labels', 'environment'))} AS environment FROM o_payload")
def _(c):
    return normalized(c).select("log_id", "environment")


@query("pii_risk", f"SELECT doc_id, {pii_sql('lower(text)')} AS pii_risk FROM documents")
def _(c):
    return documents(c).select("doc_id", text.pii_risk(F.col("text")).alias("pii_risk"))


@query("correlation_ids", "SELECT log_id, correlation_request_id, correlation_session_id, correlation_conversation_id FROM o_full")
def _(c):
    return normalized(c).select("log_id", "correlation_request_id", "correlation_session_id", "correlation_conversation_id")


@query("message_summary", "SELECT doc_id, CASE WHEN text <> '' THEN CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END END AS message_summary FROM documents")
def _(c):
    return documents(c).select("doc_id", text.summary("text").alias("message_summary"))


@query(
    "message_category",
    f"""SELECT log_id, {category_sql("contains(lower(source_table), 'audit')", level_sql('severity') + ' >= 500', "CAST(NULL AS VARCHAR)", 'message')} AS message_category FROM logs""",
)
def _(c):
    flags = n.flags("source_table", n.severity_level("severity"), "trace_id")
    category = n.message_category(flags["is_audit"], flags["is_error"], F.lit(None).cast("string"), "message")
    return c.logs.select("log_id", category.alias("message_category"))


QUICK = f"""CASE WHEN is_audit OR contains(log_type, 'audit') THEN
      CASE WHEN {any_word('t', 'login', 'signin', 'auth', 'token')} THEN 'authentication' WHEN {any_word('t', 'permission', 'access', 'denied', 'forbidden')} THEN 'authorization'
           WHEN {any_word('t', 'read', 'write', 'delete', 'create', 'update')} THEN 'data_access' ELSE 'security' END
     WHEN contains(s, 'build') OR contains(t, 'deploy') OR log_type = 'build' THEN 'deployment'
     WHEN is_error OR coalesce(error_message, '') <> '' THEN 'error'
     WHEN is_request OR coalesce(http_method, '') <> '' THEN CASE WHEN http_status >= 400 THEN 'error' WHEN http_latency_ms > 1000 THEN 'performance' ELSE 'network' END
     WHEN {any_word('t', 'security', 'threat', 'attack', 'vulnerability')} THEN 'security' WHEN {any_word('t', 'config', 'setting', 'environment')} THEN 'configuration'
     WHEN log_type = 'system' OR contains(s, 'syslog') THEN 'system' END"""
QUICK_FROM = "FROM (SELECT *, lower(coalesce(message, '')) AS t, lower(coalesce(service_name, '')) AS s FROM o_normal) AS q"


@query("quick_classify", f"SELECT log_id, {QUICK} AS category {QUICK_FROM}")
def _(c):
    rows = unified(c)
    return rows.select("log_id", n.quick_category(rows).alias("category"))


@query(
    "light_classify",
    f"""SELECT log_id, CASE WHEN message <> '' THEN substr(message, 1, 200) END AS message_summary,
        CASE WHEN contains(lower(source_table), 'audit') THEN 'security' WHEN severity IN ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY') THEN 'error'
             WHEN contains(lower(source_table), 'request') THEN 'network' WHEN contains(lower(source_table), 'build') THEN 'deployment'
             WHEN {any_word('lower(message)', 'auth', 'login')} THEN 'authentication' ELSE 'application' END AS message_category FROM logs""",
)
def _(c):
    flags = n.flags("source_table", n.severity_level("severity"), "trace_id")
    return n.light_classify(c.logs.withColumns(flags)).select("log_id", "message_summary", "message_category")


@query("classify_or_other", f"SELECT log_id, coalesce({QUICK}, 'other') AS message_category, {present('message_summary', 'substr(message, 1, 200)')} AS message_summary {QUICK_FROM}")
def _(c):
    return n.classify_or_other(unified(c)).select("log_id", "message_category", "message_summary")


NORMAL_COLUMNS = """log_id insert_id event_timestamp receive_timestamp etl_timestamp severity severity_level log_type source_dataset source_table source_log_name stream_id
    resource_type resource_project resource_name resource_location service_name service_version service_method message text_payload json_payload proto_payload audit_payload
    http_method http_url http_status http_latency_ms http_user_agent http_remote_ip http_request_size http_response_size trace_id span_id trace_sampled parent_span_id
    operation_id operation_producer operation_first operation_last source_file source_line source_function principal_email principal_type caller_ip caller_network
    error_message error_code error_stack_trace is_error is_audit is_request has_trace schema_version environment correlation_request_id correlation_session_id
    correlation_conversation_id privacy_pii_risk privacy_redaction_state privacy_retention_class message_summary message_category log_date cluster_key""".split()


@query("normalize_logs", f"SELECT {', '.join(NORMAL_COLUMNS)} FROM o_normal")
def _(c):
    return normalized(c).select(*NORMAL_COLUMNS)


@query(
    "normalization_stats",
    f"""SELECT count(*) AS processed, count(*) FILTER (WHERE text_payload <> '') AS text_payloads, count(*) FILTER (WHERE hj) AS json_payloads,
        count(*) FILTER (WHERE hp) AS proto_payloads, count(*) FILTER (WHERE ha) AS audit_logs,
        count(*) FILTER (WHERE {level_sql(f"CASE WHEN hj AND lvl IN ({SEVERITY_LIST}) THEN lvl ELSE severity END")} >= 500) AS errors FROM o_parsed""",
)
def _(c):
    return n.normalization_stats(c.records.withColumn("had_text", F.coalesce("text_payload", F.lit("")) != ""))


PAYLOAD_FIELDS = "log_id tenant_id service_name severity log_type timestamp source_table message".split()


@query(
    "validate_payload",
    f"""WITH p AS (SELECT log_id, 'tenant-' || right(log_id, 1) AS tenant_id, service_name, severity, {log_type_sql('source_table')} AS log_type,
                   event_timestamp AS timestamp, source_table, message FROM logs)
        SELECT log_id, CAST(year(timestamp) AS INTEGER) AS timestamp_year, CAST(month(timestamp) AS INTEGER) AS timestamp_month,
               CAST(day(timestamp) AS INTEGER) AS timestamp_day, CAST(hour(timestamp) AS INTEGER) AS timestamp_hour,
               concat_ws('; ', CASE WHEN service_name IS NULL THEN 'missing service_name' END, CASE WHEN timestamp IS NULL THEN 'missing timestamp' END,
                         CASE WHEN severity NOT IN ({SEVERITY_LIST}) THEN 'invalid severity' END,
                         CASE WHEN log_type NOT IN ({", ".join(repr(x) for x in PAYLOAD_LOG_TYPES)}) THEN 'invalid log_type' END,
                         CASE WHEN length(message) > 10000 THEN 'message too long' END) AS reasons FROM p""",
)
def _(c):
    payload = c.logs.select(
        "log_id",
        F.concat(F.lit("tenant-"), F.expr("right(log_id, 1)")).alias("tenant_id"),
        "service_name",
        "severity",
        n.log_type("source_table").alias("log_type"),
        F.col("event_timestamp").alias("timestamp"),
        "source_table",
        "message",
    )
    checked = n.validate_payload(payload, allowed=[*PAYLOAD_FIELDS, "body"], required=PAYLOAD_FIELDS[:-1])
    return checked.select("log_id", "timestamp_year", "timestamp_month", "timestamp_day", "timestamp_hour", F.array_join("reasons", "; ").alias("reasons"))


def redact_sql(column: str) -> str:
    email = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
    octet = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    step = f"regexp_replace({column}, '{email}', '<EMAIL_REDACTED>', 'g')"
    step = f"regexp_replace({step}, '\\b(?:{octet}\\.){{3}}{octet}\\b', '<IPV4_REDACTED>', 'g')"
    step = f"regexp_replace({step}, '(Authorization:\\sBearer\\s)[a-zA-Z0-9_\\-\\.]+', '\\1<BEARER_TOKEN_REDACTED>', 'g')"
    return f"regexp_replace({step}, '(key=)[A-Za-z0-9_\\-]+', '\\1<API_KEY_REDACTED>', 'g')"


@query("redact_text", f"SELECT doc_id, {redact_sql('text')} AS text FROM documents")
def _(c):
    return documents(c).select("doc_id", text.redact("text").alias("text"))


@query("redact_nested", f"SELECT conv_id, turn, role, {redact_sql('text')} AS body, {redact_sql('text')} AS part FROM conversations")
def _(c):
    nested = c.conversations.select(
        "conv_id", "turn", F.struct("role", F.col("text").alias("body"), F.array("text").alias("parts"), F.create_map(F.lit("t"), "text").alias("m")).alias("message")
    )
    clean = text.redact_value(F.col("message"), nested.schema["message"].dataType)
    out = nested.select("conv_id", "turn", clean.alias("message"))
    return out.select("conv_id", "turn", "message.role", "message.body", F.element_at("message.parts", 1).alias("part"))


@query(
    "envelope",
    f"""SELECT log_id, schema_version, log_type AS event_type, source_table AS event_source, event_timestamp AS event_ts, etl_timestamp AS ingest_ts,
        resource_project AS project_id, environment, service_name, service_version AS service_revision, resource_type AS service_runtime,
        trace_id, span_id, trace_sampled AS sampled, principal_email AS user_id, {present(js('labels', 'tenant_id'), js('labels', 'tenantId'), js('labels', 'tenant'))} AS tenant_id,
        coalesce(caller_ip, http_remote_ip) AS ip, http_user_agent AS user_agent, etl_version AS source_version, md5(source_table || ':1.0.0') AS schema_hash,
        CAST(CASE WHEN json_valid(labels) THEN 3 ELSE 0 END AS INTEGER) AS label_count, {js('user_labels', 'tag')} AS tags,
        coalesce(correlation_request_id, operation_id) AS request_id, correlation_session_id AS session_id, correlation_conversation_id AS conversation_id,
        parent_span_id AS parent_event_id, privacy_pii_risk AS pii_risk, privacy_redaction_state AS redaction_state, privacy_retention_class AS retention_class
        FROM o_normal""",
)
def _(c):
    e = "universal_envelope"
    flat = {
        "schema_version": "schema_version", "event_type": "event_type", "event_source": "event_source", "event_ts": "event_ts", "ingest_ts": "ingest_ts",
        "project_id": "project_id", "environment": "environment", "service_name": "service.name", "service_revision": "service.revision",
        "service_runtime": "service.runtime", "trace_id": "trace.trace_id", "span_id": "trace.span_id", "sampled": "trace.sampled",
        "user_id": "actor.user_id", "tenant_id": "actor.tenant_id", "ip": "actor.ip", "user_agent": "actor.user_agent",
        "source_version": "versioning.source_version", "schema_hash": "versioning.schema_hash", "request_id": "correlation.request_id",
        "session_id": "correlation.session_id", "conversation_id": "correlation.conversation_id", "parent_event_id": "correlation.parent_event_id",
        "pii_risk": "privacy.pii_risk", "redaction_state": "privacy.redaction_state", "retention_class": "privacy.retention_class",
    }
    return enveloped(c).select(
        "log_id",
        *[F.col(f"{e}.{path}").alias(name) for name, path in flat.items()],
        F.size(f"{e}.labels").alias("label_count"),
        F.array_join(f"{e}.tags", ",").alias("tags"),
    )


@query(
    "envelope_tool_events",
    """SELECT invocation_id, 'tool_invocation' AS event_type, 'app.agent' AS event_source, started_at AS event_ts, 'prod' AS environment, trace_id, user_id,
       started_at + duration_ms * INTERVAL '1' MILLISECOND AS updated_at, session_id, invocation_id AS request_id, 'low' AS pii_risk, tool_name, status FROM tool_inv""",
)
def _(c):
    e = "universal_envelope"
    return n.envelope_tool_events(c.tool_inv).select(
        "invocation_id", f"{e}.event_type", f"{e}.event_source", f"{e}.event_ts", f"{e}.environment", F.col(f"{e}.trace.trace_id").alias("trace_id"),
        F.col(f"{e}.actor.user_id").alias("user_id"), F.col(f"{e}.lifecycle.updated_at").alias("updated_at"),
        F.col(f"{e}.correlation.session_id").alias("session_id"), F.col(f"{e}.correlation.request_id").alias("request_id"),
        F.col(f"{e}.privacy.pii_risk").alias("pii_risk"), "tool_name", "status",
    )


@query(
    "labels_to_array",
    f"""WITH x AS (SELECT log_id, CASE WHEN json_valid(labels) THEN labels END AS j FROM records),
        k AS (SELECT log_id, unnest(json_keys(j)) AS k, j FROM x WHERE j IS NOT NULL) SELECT log_id, k, json_extract_string(j, '$."' || k || '"') AS v FROM k""",
)
def _(c):
    return c.records.select("log_id", F.inline(n.labels_to_array("labels")))


@query("tags", f"SELECT log_id, {js('user_labels', 'tag')} AS tag FROM logs_rich")
def _(c):
    return c.logs_rich.select("log_id", F.explode(n.tags("user_labels")).alias("tag"))


@query("tenant_id", f"SELECT log_id, {present(js('labels', 'tenant_id'), js('labels', 'tenantId'), js('labels', 'tenant'))} AS tenant_id FROM logs_rich")
def _(c):
    parsed = c.logs_rich.withColumn("_l", F.from_json("labels", MAP))
    return parsed.select("log_id", n.tenant_id(F.col("_l")).alias("tenant_id"))


@query(
    "environment_by_view",
    f"""SELECT log_id, coalesce({present(js('labels', 'env'), js('labels', 'environment'))}, CASE WHEN {any_word('lower(service_name)', '-dev', '_dev')} THEN 'dev'
        WHEN {any_word('lower(service_name)', '-staging', '_staging')} THEN 'staging' ELSE 'prod' END) AS environment FROM o_payload""",
)
def _(c):
    rows = n.payload_columns(n.parse_record(c.records))
    return rows.select("log_id", n.environment_by_view(F.col("_labels"), "service_name").alias("environment"))


@query(
    "pii_risk_keywords",
    f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{PII_KEYWORDS_HIGH}') THEN 'high' WHEN regexp_matches(text, '{PII_KEYWORDS_MODERATE}') THEN 'moderate'
        WHEN regexp_matches(text, '{PII_KEYWORDS_LOW}') THEN 'low' ELSE 'none' END AS pii_risk FROM documents""",
)
def _(c):
    return documents(c).select("doc_id", text.pii_risk_keywords("text", F.lit(None).cast("string")).alias("pii_risk"))


@query(
    "error_fingerprint",
    f"""SELECT log_id, md5(coalesce(nullif(service_name, ''), 'unknown') || coalesce({present('http_method', js('json_payload', 'requestMethod'))}, '') ||
        coalesce({present('http_url', js('json_payload', 'requestUrl'))}, '') || coalesce({present('CAST(http_status AS VARCHAR)', js('json_payload', 'status'))}, '') ||
        coalesce(message, '')) AS error_fingerprint FROM o_normal""",
)
def _(c):
    key = n.error_fingerprint("service_name", "http_method", "http_url", "http_status", "message", "json_payload")
    return unified(c).select("log_id", key.alias("error_fingerprint"))


ALERT_TEXT = f"""SELECT log_id, severity || ' | ' || coalesce(service_name, 'unknown') || ' | ' ||
        m AS alert_text
        FROM (SELECT *, coalesce(text_payload, {js('json_payload', 'message')}, {js('json_payload', 'msg')}, json_payload, {js('proto_payload', 'status.message')},
              proto_payload, '') AS m FROM o_payload) AS q WHERE severity IN ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY')"""


@query("alert_messages", ALERT_TEXT)
def _(c):
    return n.alert_messages(n.payload_columns(n.parse_record(c.records))).select("log_id", "alert_text")


@query("missing_summary_fallback", "SELECT log_id, substr(message, 1, 200) AS message_summary FROM logs")
def _(c):
    return c.logs.select("log_id", first_present(F.lit(None).cast("string"), F.substring("message", 1, 200)).alias("message_summary"))
