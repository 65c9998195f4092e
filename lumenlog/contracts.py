"""Fixed values and schemas that the data model prescribes."""

from __future__ import annotations

from pyspark.sql import types as T

# The nine severities and their levels; anything else has level 0.
SEVERITY_LEVELS = {
    "DEFAULT": 0,
    "DEBUG": 100,
    "INFO": 200,
    "NOTICE": 300,
    "WARNING": 400,
    "ERROR": 500,
    "CRITICAL": 600,
    "ALERT": 700,
    "EMERGENCY": 800,
}
SEVERITIES = list(SEVERITY_LEVELS)
ERROR_LEVEL = 500
ERROR_SEVERITIES = ["ERROR", "CRITICAL", "ALERT", "EMERGENCY"]

# Limits of the list queries.
DEFAULT_LIMIT, DEFAULT_HOURS = 100, 24
MAX_LIMIT, MAX_HOURS = 1000, 168

# Text caps of the unified log table.
MESSAGE_CAP, SUMMARY_CAP = 10_000, 200

# Log types a vector payload may carry.
PAYLOAD_LOG_TYPES = ["application", "system", "audit"]

# Message categories.
LOG_CATEGORIES = [
    "authentication",
    "authorization",
    "data_access",
    "deployment",
    "error",
    "performance",
    "security",
    "system",
    "application",
    "network",
    "configuration",
    "other",
]

# Redaction patterns, applied in this order; group 1 (where present) is kept.
REDACTIONS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "IPV4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "BEARER_TOKEN": r"(?<=Authorization:\sBearer\s)[a-zA-Z0-9_\-\.]+",
    "API_KEY": r"(?<=key=)[A-Za-z0-9_\-]+",
}

# Personal-data patterns of the row normaliser, by tier.
PII_HIGH = [
    r"password\s*[=:]\s*\S+",
    r"secret\s*[=:]\s*\S+",
    r"api[_-]?key\s*[=:]\s*\S+",
    r"token\s*[=:]\s*\S+",
    r"authorization\s*[=:]\s*bearer",
    r"private[_-]?key",
    r"access[_-]?token",
    r"refresh[_-]?token",
]
PII_MODERATE = [
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"ssn\s*[=:]\s*\d",
]
PII_LOW = [
    r"user[_-]?id\s*[=:]\s*\S+",
    r"account[_-]?id\s*[=:]\s*\S+",
    r"customer[_-]?id\s*[=:]\s*\S+",
]

# Personal-data patterns of the envelope view, by tier (broader than the above).
PII_KEYWORDS_HIGH = r"(?i)(password|secret|token|api[_-]?key|authorization|bearer|credit[_-]?card|ssn|social[_-]?security)"
PII_KEYWORDS_MODERATE = r"(?i)(email|phone|address|ip[_-]?address|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b)"
PII_KEYWORDS_LOW = r"(?i)(user[_-]?id|account[_-]?id|customer)"

# How an error is recognised inside a text, in this order.
ERROR_TEXT_PATTERNS = [
    r"(?i)error[:\s]+([^\n]+)",
    r"(?i)exception[:\s]+([^\n]+)",
    r"(?i)failed[:\s]+([^\n]+)",
]
ERROR_TYPE_PATTERN = r"^([A-Za-z]+Error|Exception|[A-Z][a-z]+Exception):?"

# Identifiers of billed services.
SERVICE_NAMES = {
    "24E6-581D-38E5": "BigQuery",
    "152E-C115-5142": "Cloud Run",
    "6F81-5844-456A": "Compute Engine",
    "95FF-2EF5-5EA1": "Cloud Storage",
    "CF07-9B5E-8035": "Cloud Functions",
    "A1E8-BE35-7EBC": "Cloud SQL",
    "58CD-8F1B-D6C5": "Kubernetes Engine",
    "2062-016F-44A2": "App Engine",
    "D5D1-5F71-F8A9": "Cloud Load Balancing",
    "F25E-5C5C-EDA1": "Cloud CDN",
}

# Token estimate of a tool's output; unknown tools count 1000, 20 results are the baseline.
TOOL_TOKENS = {
    "bq_query_tool": 5000,
    "search_logs_tool": 3000,
    "analyze_logs": 4000,
    "get_log_summary": 1000,
    "find_related_logs": 2000,
    "trace_lookup_tool": 1500,
    "service_health_tool": 500,
    "semantic_search_logs": 2000,
}
DEFAULT_TOOL_TOKENS, TOOL_LIMIT_BASELINE, USD_PER_1000_TOKENS = 1000, 20, 0.01

# Retention in days per table.
RETENTION_DAYS = {
    "billing_detailed_current": 180,
    "service_costs_detailed": 365,
    "pricing_export": 730,
    "cud_export": 1095,
    "billing_detailed_archive": 2555,
    "workforce_cost_attribution": 1095,
    "chat_events": 365,
}

# On-demand price per scanned TiB and job types that are billed.
USD_PER_TIB = 6.25
BILLED_JOB_TYPES = ["QUERY", "LOAD", "EXPORT", "COPY"]

# Labels every table must carry.
REQUIRED_LABELS = ["env", "team", "owner", "data_product", "version"]

# Status texts of the validation report.
FRESH, STALE, VERY_OLD = "✅ Fresh", "⚠️ Stale", "❌ Very Old"
HIGH_SKEW, MODERATE_SKEW, BALANCED = "⚠️ High Skew", "⚠️ Moderate Skew", "✅ Balanced"
GOOD_CLUSTERING, OVER_CLUSTERED, UNDER_CLUSTERED = "✅ Good Clustering", "⚠️ Over-clustered", "⚠️ Under-clustered"
LABELS_COMPLETE, LABELS_MISSING = "✅ Complete", "⚠️ Missing Required Labels"
HEALTHY, HEALTH_STALE, NO_DATA, VERY_STALE = "✅ Healthy", "⚠️ Stale", "❌ No Data", "❌ Very Stale"
ALL_LOG_IDS, GOOD_TRACES = "✅ All log_ids present", "✅ Good trace coverage"
DIVERSE_ASSETS, LIMITED_ASSETS = "✅ Diverse asset types", "⚠️ Limited asset types"
MULTI_PROJECT, SINGLE_PROJECT = "✅ Multi-project data", "⚠️ Single project only"

# Name given to the data set of the logging sinks where a caller names none.
SOURCE_DATASET = "logs"

# Columns of the canonical contract.
CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("insert_id", T.StringType()),
        T.StructField("event_timestamp", T.TimestampType()),
        T.StructField("receive_timestamp", T.TimestampType()),
        T.StructField("severity", T.StringType()),
        T.StructField("log_name", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("resource_labels", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("trace_sampled", T.BooleanType()),
        T.StructField("text_payload", T.StringType()),
        T.StructField("json_payload", T.StringType()),
        T.StructField("proto_payload", T.StringType()),
        T.StructField("display_message", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("source_table", T.StringType()),
        T.StructField("source_bucket", T.StringType()),
        T.StructField("ingestion_method", T.StringType()),
    ]
)
CANONICAL_COLUMNS = CANONICAL_SCHEMA.fieldNames()

# Columns of a raw sink table the extractor asks for, where they exist.
RAW_CORE_FIELDS = ["timestamp", "severity", "insertId", "logName", "receiveTimestamp", "trace", "spanId", "traceSampled"]
RAW_PAYLOAD_FIELDS = ["textPayload", "jsonPayload", "protoPayload", "protopayload_auditlog"]
RAW_CONTEXT_FIELDS = ["resource", "httpRequest", "operation", "sourceLocation", "labels"]
LOG_MARKER_FIELDS = ["timestamp", "severity", "logName"]

# Columns of a listed log row.
DISPLAY_FIELDS = [
    "log_id",
    "event_timestamp",
    "severity",
    "service_name",
    "source_log_name",
    "message",
    "source_table",
    "stream_id",
    "trace_id",
    "span_id",
    "log_type",
    "resource_type",
]
COUNTABLE_FIELDS = ["severity", "service_name", "source_table", "resource_type"]
