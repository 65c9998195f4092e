"""SQL views shared by the SQL twins: the normalised row, its envelope and the canonical contract."""

from __future__ import annotations

from lumenlog.adapters import ORACLE_VIEWS
from lumenlog.contracts import PII_HIGH, PII_LOW, PII_MODERATE, SEVERITIES

SEVERITY_LIST = ", ".join(f"'{s}'" for s in SEVERITIES)


def level_sql(column: str) -> str:
    return (
        f"CAST(CASE {column} WHEN 'DEFAULT' THEN 0 WHEN 'DEBUG' THEN 100 WHEN 'INFO' THEN 200 WHEN 'NOTICE' THEN 300 WHEN 'WARNING' THEN 400 "
        "WHEN 'ERROR' THEN 500 WHEN 'CRITICAL' THEN 600 WHEN 'ALERT' THEN 700 WHEN 'EMERGENCY' THEN 800 ELSE 0 END AS INTEGER)"
    )


def log_type_sql(column: str) -> str:
    c = f"lower({column})"
    return (
        f"CASE WHEN contains({c}, 'audit') THEN 'audit' WHEN contains({c}, 'request') THEN 'request' WHEN contains({c}, 'build') THEN 'build' "
        f"WHEN contains({c}, 'error') THEN 'error' WHEN contains({c}, 'stderr') OR contains({c}, 'stdout') THEN 'application' "
        f"WHEN contains({c}, 'system') OR contains({c}, 'syslog') THEN 'system' ELSE 'application' END"
    )


def js(json: str, path: str) -> str:
    """Scalar of a JSON text, null where the text is broken."""
    return f"json_extract_string(CASE WHEN json_valid({json}) THEN {json} END, '$.{path}')"


def present(*parts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({p}, '')" for p in parts) + ")"


def _alternation(patterns: list[str]) -> str:
    return "(?i)(?:" + "|".join(patterns).replace("'", "''") + ")"


def pii_sql(text: str) -> str:
    return (
        f"CASE WHEN coalesce({text}, '') = '' THEN 'none' WHEN regexp_matches({text}, '{_alternation(PII_HIGH)}') THEN 'high' "
        f"WHEN regexp_matches({text}, '{_alternation(PII_MODERATE)}') THEN 'moderate' "
        f"WHEN regexp_matches({text}, '{_alternation(PII_LOW)}') THEN 'low' ELSE 'none' END"
    )


def error_sql(text: str) -> str:
    parts = [f"nullif(regexp_extract({text}, '(?i){w}[:\\s]+([^\\n]+)', 1), '')" for w in ("error", "exception", "failed")]
    return f"coalesce({', '.join(parts)})"


def any_word(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def category_sql(audit: str, error: str, method: str, message: str) -> str:
    m = f"lower(coalesce({message}, ''))"
    return (
        f"CASE WHEN {audit} THEN 'audit' WHEN {error} THEN 'error' WHEN coalesce({method}, '') <> '' THEN 'request' "
        f"WHEN {any_word(m, 'metric', 'gauge', 'counter', 'histogram')} THEN 'metric' WHEN {any_word(m, 'debug', 'trace', 'verbose')} THEN 'debug' "
        f"WHEN {any_word(m, 'warn', 'warning')} THEN 'warning' ELSE 'info' END"
    )


def environment_sql(service: str, *explicit: str) -> str:
    s = f"lower({service})"
    return (
        f"coalesce({present(*explicit)}, CASE WHEN {any_word(s, '-dev', '_dev')} THEN 'dev' WHEN {any_word(s, '-staging', '_staging')} THEN 'staging' "
        f"WHEN {any_word(s, '-test', '_test')} THEN 'test' ELSE 'prod' END)"
    )


def _filled(c: str) -> str:
    return f"coalesce({c} NOT IN ('', '{{}}'), false)"


ORACLE_VIEWS["o_parsed"] = f"""
SELECT *, {_filled('json_payload')} AS hj, {_filled('proto_payload')} AS hp, {_filled('audit_payload')} AS ha,
       {present(js('resource_labels', 'service_name'), js('resource_labels', 'function_name'), js('resource_labels', 'instance_id'),
                js('resource_labels', 'job_name'), js('resource_labels', 'cluster_name'))} AS resource_name,
       upper({js('json_payload', 'level')}) AS lvl
FROM records
"""

ORACLE_VIEWS["o_payload"] = f"""
SELECT p.* EXCLUDE (severity, text_payload),
       CASE WHEN hj AND lvl IN ({SEVERITY_LIST}) THEN lvl ELSE severity END AS severity,
       {present('text_payload', f"CASE WHEN hj THEN {js('json_payload', 'message')} END")} AS text_payload,
       {js('resource_labels', 'project_id')} AS resource_project,
       {present(js('resource_labels', 'location'), js('resource_labels', 'region'), js('resource_labels', 'zone'))} AS resource_location,
       {present(js('resource_labels', 'revision_name'), js('resource_labels', 'version_id'))} AS service_version,
       coalesce(CASE WHEN ha THEN {js('audit_payload', 'serviceName')} END, CASE WHEN hp THEN {js('proto_payload', 'serviceName')} END,
                {present('resource_name', 'resource_type', "'unknown'")}) AS service_name,
       CASE WHEN ha THEN {js('audit_payload', 'methodName')} WHEN hp THEN {js('proto_payload', 'methodName')} END AS service_method,
       {js('audit_payload', 'requestMetadata.callerIp')} AS caller_ip, {js('audit_payload', 'requestMetadata.callerNetwork')} AS caller_network,
       {js('audit_payload', 'authenticationInfo.principalEmail')} AS principal_email,
       {js('audit_payload', 'authenticationInfo.principalSubject')} AS principal_type,
       CASE WHEN {js('audit_payload', 'status')} IS NOT NULL THEN {js('audit_payload', 'status.code')}
            WHEN {js('proto_payload', 'status')} IS NOT NULL THEN {js('proto_payload', 'status.code')} END AS error_code,
       CASE WHEN {js('audit_payload', 'status')} IS NOT NULL THEN {js('audit_payload', 'status.message')}
            WHEN {js('proto_payload', 'status')} IS NOT NULL THEN {js('proto_payload', 'status.message')}
            WHEN hj THEN {js('json_payload', 'error')} END AS payload_error,
       {js('http_request', 'requestMethod')} AS http_method, {js('http_request', 'requestUrl')} AS http_url,
       CAST({js('http_request', 'status')} AS INTEGER) AS http_status, {js('http_request', 'userAgent')} AS http_user_agent,
       {js('http_request', 'remoteIp')} AS http_remote_ip, CAST({js('http_request', 'requestSize')} AS BIGINT) AS http_request_size,
       CAST({js('http_request', 'responseSize')} AS BIGINT) AS http_response_size,
       CASE WHEN json_type(http_request, '$.latency') = 'VARCHAR' THEN TRY_CAST(rtrim({js('http_request', 'latency')}, 's') AS DOUBLE) * 1000
            ELSE TRY_CAST({js('http_request', 'latency')} AS DOUBLE) END AS http_latency_ms,
       list_extract(string_split(nullif(trace, ''), '/'), -1) AS trace_id,
       {js('operation', 'id')} AS operation_id, {js('operation', 'producer')} AS operation_producer,
       CAST({js('operation', 'first')} AS BOOLEAN) AS operation_first, CAST({js('operation', 'last')} AS BOOLEAN) AS operation_last,
       {js('source_location', 'file')} AS source_file, CAST({js('source_location', 'line')} AS INTEGER) AS source_line,
       {js('source_location', 'function')} AS source_function,
       {log_type_sql('source_table')} AS log_type
FROM o_parsed p
"""

ORACLE_VIEWS["o_error"] = f"""
SELECT *, {present('payload_error', error_sql('text_payload'))} AS error_message,
       CASE WHEN contains(text_payload, 'Traceback') OR contains(text_payload, 'at ') THEN text_payload END AS error_stack_trace,
       {level_sql('severity')} AS severity_level,
       CASE WHEN coalesce(text_payload, '') <> '' THEN text_payload WHEN hj THEN json_payload
            WHEN ha THEN 'Audit: ' || coalesce(service_name, '') || ' ' || coalesce(service_method, '') END AS part1,
       CASE WHEN http_method <> '' AND http_url <> '' THEN '[HTTP ' || http_method || ' ' || http_url || ']' END AS part2
FROM o_payload
"""

ORACLE_VIEWS["o_message"] = """
SELECT *, contains(lower(source_table), 'audit') AS is_audit, contains(lower(source_table), 'request') AS is_request,
       severity_level >= 500 AS is_error, coalesce(trace_id, '') <> '' AS has_trace,
       coalesce(nullif(concat_ws(' | ', part1, part2, CASE WHEN coalesce(error_message, '') <> '' AND NOT contains(concat_ws(' ', part1, part2), error_message)
            THEN 'Error: ' || error_message END), ''), '[' || severity || '] ' || log_type) AS raw_message
FROM o_error
"""

ORACLE_VIEWS["o_full"] = f"""
SELECT m.*, raw_message AS message,
       '1.0.0' AS schema_version,
       {environment_sql('service_name', js('labels', 'env'), js('labels', 'environment'), js('resource_labels', 'env'), js('resource_labels', 'environment'))} AS environment,
       {present(js('labels', 'request_id'), js('labels', 'requestId'), js('labels', '"x-request-id"'), js('json_payload', 'request_id'),
                js('json_payload', 'requestId'), 'operation_id')} AS correlation_request_id,
       {present(js('labels', 'session_id'), js('labels', 'sessionId'), js('json_payload', 'session_id'), js('json_payload', 'sessionId'))} AS correlation_session_id,
       {present(js('labels', 'conversation_id'), js('labels', 'conversationId'), js('json_payload', 'conversation_id'), js('json_payload', 'conversationId'),
                js('json_payload', 'chat_id'), js('json_payload', 'thread_id'))} AS correlation_conversation_id,
       CASE WHEN is_audit THEN 'audit' ELSE 'standard' END AS privacy_retention_class, 'none' AS privacy_redaction_state,
       CAST(event_timestamp AS DATE) AS log_date, severity || ':' || coalesce(service_name, 'unknown') AS cluster_key
FROM o_message m
"""

ORACLE_VIEWS["o_normal"] = f"""
SELECT f.*, {pii_sql("lower(concat_ws(' ', nullif(message, ''), nullif(text_payload, ''), CASE WHEN hj THEN json_payload END))")} AS privacy_pii_risk,
       CASE WHEN message <> '' THEN CASE WHEN length(message) > 200 THEN substr(message, 1, 200) || '...' ELSE message END END AS message_summary,
       {category_sql('is_audit', 'is_error', 'http_method', 'message')} AS message_category
FROM o_full f
"""
