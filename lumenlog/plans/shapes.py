"""DataFrames several plans start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.adapters import Tables
from lumenlog.operators import mappings, normalize
from lumenlog.session import pieces, scratch_path
from lumenlog.sources.io import write_clustered

#: Bytes of the stored events that a task parses, or lays out as unified rows, which are some hundred times wider.
PARSED_BYTES, STORED_BYTES = 4 << 20, 1 << 20

_STORED: dict[tuple[str, str], str] = {}


def typed_logs(c: Tables) -> DataFrame:
    """The log rows with the columns a listing shows."""
    return c.logs.withColumns({"log_type": normalize.log_type("source_table"), "source_log_name": F.col("source_table")})


def normalized(c: Tables) -> DataFrame:
    """Unified rows computed from the raw records."""
    return normalize.normalize_logs(c.spread(PARSED_BYTES, events="event_id").records)


def documents(c: Tables) -> DataFrame:
    """Whole texts, spread over the cores."""
    return c.spread(documents="doc_id").documents


def enveloped(c: Tables) -> DataFrame:
    return normalize.envelope(normalized(c))


def unified(c: Tables) -> DataFrame:
    """The stored unified table: partitioned by day, clustered, with the envelope.

    Written once per session and data folder; the queries over it then read only the columns and days they need instead of
    parsing every payload again. The narrow events are placed by day in pieces of bounded size before they are parsed, so the wide rows
    are never shuffled and a task sorts few of them, however many a day has.
    """
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    if key not in _STORED:
        path = scratch_path(c.spark, "unified")
        days = c.events.repartitionByRange(pieces(c.events, STORED_BYTES), F.to_date("ts"), "event_id")
        rows = normalize.envelope(normalize.normalize_logs(c.replaced(events=days).records))
        write_clustered(rows, path, "log_date", ["severity", "service_name", "resource_type"], placed=True)
        _STORED[key] = path
    return c.spark.read.parquet(_STORED[key])


# Which events a raw sink holds.
SINK_KINDS = {
    "activity": "purchase",
    "data_access": "purchase",
    "system_event": "signup",
    "stdout": "view",
    "stderr": "error",
    "requests": "click",
    "varlog": "view",
    "syslog": "error",
    "build": "signup",
    "insights": "error",
    "scheduler": "click",
}


_NATIVE = "insert_id AS insertId, log_name AS logName, trace_sampled AS traceSampled"
_TEXT = "text_payload AS textPayload"
_PAYLOAD = "named_struct('message', json_message) AS jsonPayload"
_AUDIT = "named_struct('serviceName', audit_service, 'methodName', method_name) AS protopayload_auditlog"


def _resource(labels: str) -> str:
    return f"named_struct('type', resource_type, 'labels', named_struct({labels})) AS resource"


# Columns a sink has besides the time, severity and trace fields all of them share.
_SINK_COLUMNS = {
    "activity": [
        _NATIVE,
        _resource("'service_name', svc, 'module_id', build_id, 'project_id', project_id"),
        "named_struct('methodName', method_name, 'response', named_struct('message', json_message)) AS protoPayload",
    ],
    "data_access": [_NATIVE, _resource("'project_id', project_id"), _AUDIT],
    "system_event": [_NATIVE, _resource("'project_id', project_id"), _AUDIT],
    "stdout": [_resource("'service_name', svc, 'project_id', project_id"), _TEXT, _PAYLOAD],
    "stderr": [_resource("'service_name', svc, 'project_id', project_id"), _TEXT, _PAYLOAD],
    "requests": [_NATIVE, _resource("'service_name', svc"), "named_struct('requestMethod', http_method, 'requestUrl', http_url) AS httpRequest"],
    "varlog": [_resource("'service_name', svc"), _TEXT],
    "syslog": [_TEXT, _PAYLOAD],
    "build": [_NATIVE, _resource("'build_id', build_id"), _TEXT],
    "insights": [
        _NATIVE,
        _resource("'project_id', project_id"),
        _TEXT,
        "named_struct('message', json_message, 'exceptioninfo', named_struct('message', method_name), "
        "'errorevent', named_struct('message', audit_service)) AS jsonpayload_v1beta1_insight",
    ],
    "scheduler": [
        _NATIVE,
        _resource("'job_id', build_id"),
        _TEXT,
        "CASE WHEN phase < 2 THEN named_struct('jobname', job_id) END AS jsonpayload_logging_attemptstarted",
        "CASE WHEN phase IN (2, 3) THEN named_struct('jobname', job_id, 'status', project_id) END AS jsonpayload_logging_attemptfinished",
    ],
}


def raw_sink(c: Tables, name: str) -> DataFrame:
    """A raw sink table with the nested columns it has in the field; sinks differ in their columns."""
    shared = "ts AS timestamp, severity, receive_ts AS receiveTimestamp, trace, span_id AS spanId"
    columns = ", ".join([shared, *_SINK_COLUMNS[name]])
    return c.sql(f"SELECT {columns} FROM raw_flat WHERE sink_kind = '{SINK_KINDS[name]}'")


def raw_sinks(c: Tables) -> dict[str, DataFrame]:
    return {name: raw_sink(c, name) for name in SINK_KINDS}


def canonical(c: Tables) -> DataFrame:
    return mappings.canonical(raw_sinks(c))
