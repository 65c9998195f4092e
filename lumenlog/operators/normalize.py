"""From a raw log record to the unified row.

A raw record keeps its payloads, labels and request as JSON texts. Each text is parsed once, with an explicit schema, into
a struct or map that all later columns read; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.contracts import (
    ERROR_LEVEL,
    ERROR_SEVERITIES,
    MESSAGE_CAP,
    PAYLOAD_LOG_TYPES,
    SEVERITIES,
    SEVERITY_LEVELS,
    SUMMARY_CAP,
)
from lumenlog.functions.columns import cap, col, contains_any, count_if, first_present, json_field
from lumenlog.functions.text import error_in_text, pii_risk, pii_risk_keywords, stack_trace, summary

SCHEMA_VERSION = "1.0.0"
BAR = " | "

_LABELS = "map<string,string>"
_JSON_FIELDS = (
    "message string, msg string, error string, level string, request_id string, requestId string, session_id string, "
    "sessionId string, conversation_id string, conversationId string, chat_id string, thread_id string"
)
_STATUS = "status struct<code:string,message:string>"
_PROTO_FIELDS = f"methodName string, serviceName string, {_STATUS}"
_AUDIT_FIELDS = (
    f"methodName string, serviceName string, {_STATUS}, requestMetadata struct<callerIp:string,callerNetwork:string>, "
    "authenticationInfo struct<principalEmail:string,principalSubject:string>"
)
_HTTP_FIELDS = (
    "requestMethod string, requestUrl string, status int, userAgent string, remoteIp string, latency string, "
    "requestSize bigint, responseSize bigint"
)
_OPERATION_FIELDS = "id string, producer string, first boolean, last boolean"
_LOCATION_FIELDS = "file string, line int, function string"


def _filled(json: str) -> Column:
    """True for a JSON text that holds something."""
    return F.coalesce(~F.col(json).isin("", "{}"), F.lit(False))


# --- single rules -----------------------------------------------------------------------------------------------------


def log_type(source_table: str | Column) -> Column:
    table = F.lower(col(source_table))
    return (
        F.when(table.contains("audit"), "audit")
        .when(table.contains("request"), "request")
        .when(table.contains("build"), "build")
        .when(table.contains("error"), "error")
        .when(contains_any(table, ["stderr", "stdout"]), "application")
        .when(contains_any(table, ["system", "syslog"]), "system")
        .otherwise("application")
    )


def severity_level(severity: str | Column) -> Column:
    levels = F.create_map(*[F.lit(x) for pair in SEVERITY_LEVELS.items() for x in pair])
    return F.coalesce(levels[col(severity)], F.lit(0))


def resource_fields(labels: Column, resource_type: str | Column) -> dict[str, Column]:
    """Resource and service names out of the resource labels; an empty label counts as missing."""
    name = first_present(*[labels[k] for k in ("service_name", "function_name", "instance_id", "job_name", "cluster_name")])
    return {
        "resource_project": labels["project_id"],
        "resource_location": first_present(*[labels[k] for k in ("location", "region", "zone")]),
        "resource_name": name,
        "service_name": first_present(name, resource_type, F.lit("unknown")),
        "service_version": first_present(labels["revision_name"], labels["version_id"]),
    }


def latency_ms(text: str | Column, is_text: Column | None = None) -> Column:
    """A text such as '0.123s' is seconds, a bare JSON number already milliseconds; anything else is unknown."""
    number = F.regexp_replace(col(text), "s+$", "").try_cast("double")
    return number * 1000 if is_text is None else F.when(is_text, number * 1000).otherwise(number)


def last_segment(trace: str | Column) -> Column:
    return F.element_at(F.split(F.nullif(col(trace), F.lit("")), "/"), -1)


def environment(labels: Column, resource_labels: Column, service: str | Column) -> Column:
    """Explicit labels first, then the service name's suffix, else production."""
    lowered = F.lower(col(service))
    return F.coalesce(
        first_present(labels["env"], labels["environment"], resource_labels["env"], resource_labels["environment"]),
        F.when(contains_any(lowered, ["-dev", "_dev"]), "dev")
        .when(contains_any(lowered, ["-staging", "_staging"]), "staging")
        .when(contains_any(lowered, ["-test", "_test"]), "test")
        .otherwise("prod"),
    )


def environment_by_view(labels: Column, service: str | Column) -> Column:
    """The envelope view's rule: labels, then the service name (with a prod and without a test rule)."""
    lowered = F.lower(col(service))
    return F.coalesce(
        first_present(labels["env"], labels["environment"]),
        F.when(contains_any(lowered, ["-dev", "_dev"]), "dev")
        .when(contains_any(lowered, ["-staging", "_staging"]), "staging")
        .when(contains_any(lowered, ["-prod", "_prod"]), "prod")
        .otherwise("prod"),
    )


def tenant_id(labels: Column) -> Column:
    return first_present(labels["tenant_id"], labels["tenantId"], labels["tenant"])


def labels_to_array(json: str | Column) -> Column:
    """JSON object as an array of (k, v); empty for a missing or broken text."""
    pairs = F.map_entries(F.from_json(col(json), _LABELS))
    shaped = F.transform(pairs, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return F.coalesce(shaped, F.array().cast("array<struct<k:string,v:string>>"))


def tags(user_labels: str | Column) -> Column:
    """Values of the labels named tag or tags."""
    return F.transform(F.filter(labels_to_array(user_labels), lambda e: e["k"].isin("tag", "tags")), lambda e: e["v"])


def message_category(is_audit: Column, is_error: Column, http_method: str | Column, message: str | Column) -> Column:
    text = F.lower(F.coalesce(col(message), F.lit("")))
    return (
        F.when(is_audit, "audit")
        .when(is_error, "error")
        .when(F.coalesce(col(http_method), F.lit("")) != "", "request")
        .when(contains_any(text, ["metric", "gauge", "counter", "histogram"]), "metric")
        .when(contains_any(text, ["debug", "trace", "verbose"]), "debug")
        .when(contains_any(text, ["warn", "warning"]), "warning")
        .otherwise("info")
    )


def quick_category(df: DataFrame) -> Column:
    """Category of a unified row by keywords; null where the rules do not decide."""
    text, service = F.lower(F.coalesce("message", F.lit(""))), F.lower(F.coalesce("service_name", F.lit("")))
    audit = (
        F.when(contains_any(text, ["login", "signin", "auth", "token"]), "authentication")
        .when(contains_any(text, ["permission", "access", "denied", "forbidden"]), "authorization")
        .when(contains_any(text, ["read", "write", "delete", "create", "update"]), "data_access")
        .otherwise("security")
    )
    request = (
        F.when(F.col("http_status") >= 400, "error").when(F.col("http_latency_ms") > 1000, "performance").otherwise("network")
    )
    return (
        F.when(F.col("is_audit") | F.col("log_type").contains("audit"), audit)
        .when(service.contains("build") | text.contains("deploy") | (F.col("log_type") == "build"), "deployment")
        .when(F.col("is_error") | (F.coalesce("error_message", F.lit("")) != ""), "error")
        .when(F.col("is_request") | (F.coalesce("http_method", F.lit("")) != ""), request)
        .when(contains_any(text, ["security", "threat", "attack", "vulnerability"]), "security")
        .when(contains_any(text, ["config", "setting", "environment"]), "configuration")
        .when((F.col("log_type") == "system") | service.contains("syslog"), "system")
    )


def light_category() -> Column:
    """The cheap six-way rule for high volume."""
    text = F.lower(F.coalesce("message", F.lit("")))
    return (
        F.when(F.col("is_audit"), "security")
        .when(F.col("is_error") | F.col("severity").isin(ERROR_SEVERITIES), "error")
        .when(F.col("is_request"), "network")
        .when(F.lower("source_table").contains("build"), "deployment")
        .when(contains_any(text, ["auth", "login"]), "authentication")
        .otherwise("application")
    )


def light_classify(df: DataFrame) -> DataFrame:
    """Cheap category and the first 200 characters as the summary."""
    return df.withColumns(
        {
            "message_summary": F.when(F.coalesce("message", F.lit("")) != "", F.substring("message", 1, SUMMARY_CAP)),
            "message_category": light_category(),
        }
    )


def classify_or_other(df: DataFrame) -> DataFrame:
    """Undecided rows become 'other'; a missing summary becomes the shortened message."""
    return df.withColumns(
        {
            "message_category": F.coalesce(quick_category(df), F.lit("other")),
            "message_summary": first_present("message_summary", F.substring("message", 1, SUMMARY_CAP)),
        }
    )


def flags(source_table: str | Column, level: Column, trace: str | Column) -> dict[str, Column]:
    table = F.lower(col(source_table))
    return {
        "is_error": level >= ERROR_LEVEL,
        "is_audit": table.contains("audit"),
        "is_request": table.contains("request"),
        "has_trace": F.coalesce(col(trace), F.lit("")) != "",
    }


# --- the whole row ----------------------------------------------------------------------------------------------------


def parse_record(df: DataFrame) -> DataFrame:
    """Parse every JSON text of a raw record once."""
    parsed = {
        "_labels": ("labels", _LABELS),
        "_resource": ("resource_labels", _LABELS),
        "_json": ("json_payload", _JSON_FIELDS),
        "_proto": ("proto_payload", _PROTO_FIELDS),
        "_audit": ("audit_payload", _AUDIT_FIELDS),
        "_http": ("http_request", _HTTP_FIELDS),
        "_operation": ("operation", _OPERATION_FIELDS),
        "_location": ("source_location", _LOCATION_FIELDS),
    }
    return df.withColumns({name: F.from_json(F.col(source), schema) for name, (source, schema) in parsed.items()})


def payload_columns(df: DataFrame) -> DataFrame:
    """Severity, text, service, principal and error fields out of the payloads (JSON, then proto, then audit)."""
    level = F.upper("_json.level")
    has_json, has_proto, has_audit = _filled("json_payload"), _filled("proto_payload"), _filled("audit_payload")
    resource = resource_fields(F.col("_resource"), "resource_type")
    proto_service = F.coalesce(F.when(has_proto, F.col("_proto.serviceName")), resource["service_name"])

    def status(field: str) -> Column:
        proto = F.when(has_proto & F.col("_proto.status").isNotNull(), F.col(f"_proto.status.{field}"))
        audit_set = has_audit & F.col("_audit.status").isNotNull()
        return F.when(audit_set, F.col(f"_audit.status.{field}")).otherwise(proto)

    any_status = (has_proto & F.col("_proto.status").isNotNull()) | (has_audit & F.col("_audit.status").isNotNull())
    return df.withColumns(
        {
            **{k: v for k, v in resource.items() if k != "service_name"},
            "severity": F.when(has_json & level.isin(SEVERITIES), level).otherwise(F.col("severity")),
            "text_payload": first_present("text_payload", F.when(has_json, F.col("_json.message"))),
            "service_name": F.when(has_audit, F.coalesce(F.col("_audit.serviceName"), proto_service)).otherwise(proto_service),
            "service_method": F.when(has_audit, F.col("_audit.methodName")).otherwise(F.when(has_proto, F.col("_proto.methodName"))),
            "caller_ip": F.when(has_audit, F.col("_audit.requestMetadata.callerIp")),
            "caller_network": F.when(has_audit, F.col("_audit.requestMetadata.callerNetwork")),
            "principal_email": F.when(has_audit, F.col("_audit.authenticationInfo.principalEmail")),
            "principal_type": F.when(has_audit, F.col("_audit.authenticationInfo.principalSubject")),
            "error_code": F.when(any_status, F.coalesce(status("code"), F.lit(""))),
            "error_message": F.when(any_status, status("message")).otherwise(F.when(has_json, F.col("_json.error"))),
        }
    )


def context_columns(df: DataFrame) -> DataFrame:
    """Request, trace, operation and source-code fields."""
    return df.withColumns(
        {
            "http_method": F.col("_http.requestMethod"),
            "http_url": F.col("_http.requestUrl"),
            "http_status": F.col("_http.status"),
            "http_latency_ms": latency_ms("_http.latency", F.col("http_request").rlike(r'"latency"\s*:\s*"')),
            "http_user_agent": F.col("_http.userAgent"),
            "http_remote_ip": F.col("_http.remoteIp"),
            "http_request_size": F.col("_http.requestSize"),
            "http_response_size": F.col("_http.responseSize"),
            "trace_id": last_segment("trace"),
            "operation_id": F.col("_operation.id"),
            "operation_producer": F.col("_operation.producer"),
            "operation_first": F.col("_operation.first"),
            "operation_last": F.col("_operation.last"),
            "source_file": F.col("_location.file"),
            "source_line": F.col("_location.line"),
            "source_function": F.col("_location.function"),
        }
    )


def error_columns(df: DataFrame) -> DataFrame:
    """An error message found in the text where the payload gave none, and the stack trace."""
    return df.withColumns(
        {
            "error_message": first_present("error_message", error_in_text("text_payload")),
            "error_stack_trace": stack_trace("text_payload"),
        }
    )


def message_column(df: DataFrame, limit: int | None = None) -> Column:
    """One readable line: content, request, error; whole unless a limit is given."""
    content = (
        F.when(F.coalesce("text_payload", F.lit("")) != "", F.col("text_payload"))
        .when(_filled("json_payload"), F.col("json_payload"))
        .when(
            _filled("audit_payload"),
            F.concat(F.lit("Audit: "), F.coalesce("service_name", F.lit("")), F.lit(" "), F.coalesce("service_method", F.lit(""))),
        )
    )
    named = (F.coalesce("http_method", F.lit("")) != "") & (F.coalesce("http_url", F.lit("")) != "")
    request = F.when(named, F.concat(F.lit("[HTTP "), F.col("http_method"), F.lit(" "), F.col("http_url"), F.lit("]")))
    so_far = F.concat_ws(" ", content, request)
    is_new = (F.coalesce("error_message", F.lit("")) != "") & ~so_far.contains(F.col("error_message"))
    error = F.when(is_new, F.concat(F.lit("Error: "), F.col("error_message")))
    line = F.nullif(F.concat_ws(BAR, content, request, error), F.lit(""))
    fallback = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("log_type"))
    return cap(F.coalesce(line, fallback), limit)


def correlation_columns() -> dict[str, Column]:
    labels, payload = F.col("_labels"), F.col("_json")
    return {
        "correlation_request_id": first_present(
            labels["request_id"], labels["requestId"], labels["x-request-id"], payload["request_id"], payload["requestId"], F.col("operation_id")
        ),
        "correlation_session_id": first_present(labels["session_id"], labels["sessionId"], payload["session_id"], payload["sessionId"]),
        "correlation_conversation_id": first_present(
            labels["conversation_id"],
            labels["conversationId"],
            payload["conversation_id"],
            payload["conversationId"],
            payload["chat_id"],
            payload["thread_id"],
        ),
    }


def normalize_logs(records: DataFrame) -> DataFrame:
    """Unified rows from raw records: one chain of projections, no shuffle, no Python."""
    df = parse_record(records.withColumn("log_type", log_type("source_table")))
    df = error_columns(context_columns(payload_columns(df)))
    df = df.withColumn("severity_level", severity_level("severity"))
    df = df.withColumns({"message": message_column(df), **flags("source_table", F.col("severity_level"), "trace_id")})
    text = F.concat_ws(" ", F.nullif("message", F.lit("")), F.nullif("text_payload", F.lit("")), F.when(_filled("json_payload"), F.col("json_payload")))
    df = df.withColumns(
        {
            "schema_version": F.lit(SCHEMA_VERSION),
            "environment": environment(F.col("_labels"), F.col("_resource"), "service_name"),
            "privacy_pii_risk": pii_risk(text),
            "privacy_retention_class": F.when(F.col("is_audit"), "audit").otherwise("standard"),
            "privacy_redaction_state": F.lit("none"),
            **correlation_columns(),
            "message_summary": summary("message"),
            "message_category": message_category(F.col("is_audit"), F.col("is_error"), "http_method", "message"),
            "log_date": F.to_date("event_timestamp"),
            "cluster_key": F.concat(F.col("severity"), F.lit(":"), F.coalesce("service_name", F.lit("unknown"))),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def normalization_stats(records: DataFrame) -> DataFrame:
    """How many records carried which payload, and how many are errors."""
    rows = payload_columns(parse_record(records))
    return rows.agg(
        F.count("*").alias("processed"),
        count_if(_present_input(records)).alias("text_payloads"),
        count_if(_filled("json_payload")).alias("json_payloads"),
        count_if(_filled("proto_payload")).alias("proto_payloads"),
        count_if(_filled("audit_payload")).alias("audit_logs"),
        count_if(severity_level("severity") >= ERROR_LEVEL).alias("errors"),
    )


def _present_input(records: DataFrame) -> Column:
    return F.coalesce(F.col("had_text"), F.lit(False)) if "had_text" in records.columns else F.coalesce("text_payload", F.lit("")) != ""


# --- validation, envelope, fingerprints -------------------------------------------------------------------------------


def validate_payload(df: DataFrame, allowed: list[str], required: list[str]) -> DataFrame:
    """Add the derived time fields and an array of reasons; a row is valid where the array is empty.

    Fields outside the contract make every row carry the reason, as the contract forbids extras.
    """
    reasons = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required if c in df.columns]
    reasons += [F.lit(f"missing {c}") for c in required if c not in df.columns]
    reasons += [F.lit(f"extra {c}") for c in df.columns if c not in allowed]
    reasons.append(F.when(F.col("severity").isNotNull() & ~F.col("severity").isin(SEVERITIES), F.lit("invalid severity")))
    reasons.append(F.when(F.col("log_type").isNotNull() & ~F.col("log_type").isin(PAYLOAD_LOG_TYPES), F.lit("invalid log_type")))
    reasons += [F.when(F.length(c) > MESSAGE_CAP, F.lit(f"{c} too long")) for c in ("message", "body") if c in df.columns]
    ts = F.col("timestamp")
    return df.withColumns(
        {
            "timestamp_year": F.year(ts),
            "timestamp_month": F.month(ts),
            "timestamp_day": F.dayofmonth(ts),
            "timestamp_hour": F.hour(ts),
            "reasons": F.filter(F.array(*reasons), lambda x: x.isNotNull()),
        }
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reasons)"""
    ok = F.size("reasons") == 0
    return validated.filter(ok).drop("reasons"), validated.filter(~ok)


def error_fingerprint(service: str, method: str, url: str, status: str, message: str, json_payload: str) -> Column:
    """md5 of what makes two errors the same; request fields fall back to the JSON payload."""

    def pick(column: str, field: str) -> Column:
        return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.nullif(json_field(json_payload, field), F.lit("")), F.lit(""))

    return F.md5(
        F.concat(
            first_present(service, F.lit("unknown")),
            pick(method, "requestMethod"),
            pick(url, "requestUrl"),
            pick(status, "status"),
            F.coalesce(F.col(message), F.lit("")),
        )
    )


def alert_messages(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Alert text of rows of ERROR and above: severity, service and the first message any payload gives, whole unless limited."""
    picked = F.coalesce(
        F.col("text_payload"), json_field("json_payload", "message"), json_field("json_payload", "msg"), F.col("json_payload"),
        json_field("proto_payload", "status.message"), F.col("proto_payload"), F.lit(""),
    )
    text = F.concat_ws(BAR, "severity", F.coalesce("service_name", F.lit("unknown")), cap(picked, limit))
    return df.filter(F.col("severity").isin(ERROR_SEVERITIES)).withColumn("alert_text", text)


def envelope(df: DataFrame) -> DataFrame:
    """Unified rows with the nested Universal Data Envelope added."""
    labels = F.from_json("labels", _LABELS)
    null = F.lit(None).cast("string")
    nested = F.struct(
        F.coalesce("schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"),
        F.col("log_id").alias("event_id"),
        F.col("log_type").alias("event_type"),
        F.col("source_table").alias("event_source"),
        F.col("event_timestamp").alias("event_ts"),
        F.col("etl_timestamp").alias("ingest_ts"),
        F.col("resource_project").alias("project_id"),
        F.coalesce(F.col("environment"), environment_by_view(labels, "service_name")).alias("environment"),
        F.col("resource_location").alias("region"),
        null.alias("zone"),
        F.struct(
            F.col("service_name").alias("name"),
            F.col("service_version").alias("revision"),
            json_field("resource_labels", "instance_id").alias("instance_id"),
            F.col("resource_type").alias("runtime"),
        ).alias("service"),
        F.struct("trace_id", "span_id", F.col("trace_sampled").alias("sampled")).alias("trace"),
        F.struct(
            F.col("principal_email").alias("user_id"),
            tenant_id(labels).alias("tenant_id"),
            null.alias("org_id"),
            F.coalesce("caller_ip", "http_remote_ip").alias("ip"),
            F.col("http_user_agent").alias("user_agent"),
        ).alias("actor"),
        F.struct(
            F.col("event_timestamp").alias("created_at"),
            F.lit(None).cast("timestamp").alias("updated_at"),
            F.lit(None).cast("timestamp").alias("deleted_at"),
            F.lit(False).alias("is_deleted"),
        ).alias("lifecycle"),
        F.struct(
            F.lit(1).cast("bigint").alias("record_version"),
            F.col("etl_version").alias("source_version"),
            F.md5(F.concat("source_table", F.lit(":"), F.coalesce("schema_version", F.lit(SCHEMA_VERSION)))).alias("schema_hash"),
        ).alias("versioning"),
        labels_to_array("labels").alias("labels"),
        tags("user_labels").alias("tags"),
        F.struct(
            F.coalesce("correlation_request_id", "operation_id").alias("request_id"),
            F.col("correlation_session_id").alias("session_id"),
            F.col("correlation_conversation_id").alias("conversation_id"),
            json_field("resource_labels", "job_id").alias("job_id"),
            F.col("parent_span_id").alias("parent_event_id"),
        ).alias("correlation"),
        F.struct(
            F.coalesce(F.col("privacy_pii_risk"), pii_risk_keywords("message", "json_payload")).alias("pii_risk"),
            F.coalesce("privacy_redaction_state", F.lit("none")).alias("redaction_state"),
            F.coalesce(F.col("privacy_retention_class"), F.when(F.col("is_audit"), "audit").otherwise("standard")).alias("retention_class"),
        ).alias("privacy"),
    )
    return df.withColumn("universal_envelope", nested)


def envelope_tool_events(df: DataFrame, project_id: str = "proj-main", region: str = "us-central1", service: str = "log-agent") -> DataFrame:
    """Tool invocations in the same envelope."""
    null = F.lit(None).cast("string")
    nested = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("invocation_id").alias("event_id"),
        F.lit("tool_invocation").alias("event_type"),
        F.lit("app.agent").alias("event_source"),
        F.col("started_at").alias("event_ts"),
        F.col("started_at").alias("ingest_ts"),
        F.lit(project_id).alias("project_id"),
        F.lit("prod").alias("environment"),
        F.lit(region).alias("region"),
        null.alias("zone"),
        F.struct(F.lit(service).alias("name"), null.alias("revision"), null.alias("instance_id"), null.alias("runtime")).alias("service"),
        F.struct("trace_id", null.alias("span_id"), F.lit(None).cast("boolean").alias("sampled")).alias("trace"),
        F.struct("user_id", null.alias("tenant_id"), null.alias("org_id"), null.alias("ip"), null.alias("user_agent")).alias("actor"),
        F.struct(
            F.col("started_at").alias("created_at"),
            (F.col("started_at") + F.make_dt_interval(secs=F.col("duration_ms").cast("decimal(18,6)") / 1000)).alias("updated_at"),
            F.lit(None).cast("timestamp").alias("deleted_at"),
            F.lit(False).alias("is_deleted"),
        ).alias("lifecycle"),
        F.struct(F.lit(1).cast("bigint").alias("record_version"), F.lit(SCHEMA_VERSION).alias("source_version"), null.alias("schema_hash")).alias("versioning"),
        F.array().cast("array<struct<k:string,v:string>>").alias("labels"),
        F.array().cast("array<string>").alias("tags"),
        F.struct(
            F.col("invocation_id").alias("request_id"), "session_id", null.alias("conversation_id"), null.alias("job_id"), null.alias("parent_event_id")
        ).alias("correlation"),
        F.struct(F.lit("low").alias("pii_risk"), F.lit("none").alias("redaction_state"), F.lit("standard").alias("retention_class")).alias("privacy"),
    )
    return df.withColumn("universal_envelope", nested)
