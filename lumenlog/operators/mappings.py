"""One projection per raw sink onto the canonical contract, and their union.

Each mapping is a single ``select``; a filter or column pruning on the union is pushed into every branch down to its scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.contracts import CANONICAL_SCHEMA, SOURCE_DATASET
from lumenlog.functions.columns import first_present, json_field
from lumenlog.functions.ids import blank, minute_text, synthetic_insert_id, synthetic_span_id, synthetic_trace_id, ts_text

REDUCED_COLUMNS = (
    "insert_id event_timestamp receive_timestamp severity log_name service_name resource_type json_payload display_message "
    "source_dataset source_table trace_id span_id"
).split()


def _json(column: str) -> Column:
    return F.to_json(F.col(column), {"ignoreNullFields": "false"})


def _project(df: DataFrame, source_table: str, **given: Column) -> DataFrame:
    """The contract's columns in order; what a mapping does not give is null or the shared default."""
    shared = {
        "event_timestamp": F.col("timestamp"),
        "source_dataset": F.lit(SOURCE_DATASET),
        "source_table": F.lit(source_table),
        "ingestion_method": F.lit("sink"),
    }
    values = shared | given
    return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL_SCHEMA.fields])


def _trace(null_safe: bool, service: Column, *more: Column) -> Column:
    key = F.coalesce(service, F.lit("run")) if null_safe else service
    return synthetic_trace_id("trace", key, minute_text("timestamp"), *more)


def _severity(default: str = "INFO") -> Column:
    return F.coalesce("severity", F.lit(default))


def admin_activity(df: DataFrame, null_safe: bool = False) -> DataFrame:
    labels = "resource.labels"
    return _project(
        df,
        "cloudaudit_googleapis_com_activity",
        insert_id=F.col("insertId"),
        severity=_severity(),
        log_name=F.col("logName"),
        service_name=F.coalesce(f"{labels}.service_name", f"{labels}.module_id", F.lit("audit")),
        resource_type=F.coalesce("resource.type", F.lit("audited_resource")),
        resource_labels=_json(labels),
        trace_id=synthetic_trace_id("trace", F.coalesce(f"{labels}.service_name", F.lit("audit")), minute_text("timestamp")),
        span_id=synthetic_span_id("spanId", F.col("insertId")),
        json_payload=_json("protoPayload"),
        proto_payload=_json("protoPayload"),
        display_message=F.coalesce("protoPayload.response.message", "logName"),
    )


def _audit(df: DataFrame, table: str, default_service: str) -> DataFrame:
    service = F.coalesce("protopayload_auditlog.serviceName", F.lit(default_service))
    return _project(
        df,
        table,
        insert_id=F.col("insertId"),
        severity=_severity(),
        log_name=F.col("logName"),
        service_name=service,
        resource_type=F.coalesce("resource.type", F.lit("audited_resource")),
        resource_labels=_json("resource.labels"),
        trace_id=synthetic_trace_id("trace", service, minute_text("timestamp")),
        span_id=synthetic_span_id("spanId", F.col("insertId")),
        json_payload=_json("protopayload_auditlog"),
        proto_payload=_json("protopayload_auditlog"),
        display_message=F.coalesce("protopayload_auditlog.methodName", F.lit("")),
    )


def data_access(df: DataFrame, null_safe: bool = False) -> DataFrame:
    return _audit(df, "cloudaudit_googleapis_com_data_access", "bigquery")


def system_event(df: DataFrame, null_safe: bool = False) -> DataFrame:
    return _audit(df, "cloudaudit_googleapis_com_system_event", "system")


def _container(df: DataFrame, table: str, log_name: str, severity: str, null_safe: bool) -> DataFrame:
    service, when = F.col("resource.labels.service_name"), ts_text("timestamp")
    payload = _json("jsonPayload")
    return _project(
        df,
        table,
        insert_id=synthetic_insert_id(when, blank("trace"), blank("spanId"), blank("textPayload"), blank(service)),
        severity=_severity(severity),
        log_name=F.lit(log_name),
        service_name=service,
        resource_type=F.lit("cloud_run_revision") if null_safe else F.coalesce("resource.type", F.lit("cloud_run_revision")),
        resource_labels=_json("resource.labels"),
        trace_id=_trace(null_safe, service),
        span_id=synthetic_span_id("spanId", when, blank("textPayload")),
        text_payload=F.col("textPayload"),
        json_payload=F.coalesce(payload, F.lit("{}")) if null_safe else payload,
        display_message=F.col("textPayload"),
    )


def container_stdout(df: DataFrame, null_safe: bool = False) -> DataFrame:
    return _container(df, "run_googleapis_com_stdout", "run.googleapis.com/stdout", "INFO", null_safe)


def container_stderr(df: DataFrame, null_safe: bool = False) -> DataFrame:
    return _container(df, "run_googleapis_com_stderr", "run.googleapis.com/stderr", "ERROR", null_safe)


def http_requests(df: DataFrame, null_safe: bool = False) -> DataFrame:
    service, when, url = F.col("resource.labels.service_name"), ts_text("timestamp"), F.col("httpRequest.requestUrl")
    return _project(
        df,
        "run_googleapis_com_requests",
        insert_id=F.coalesce("insertId", synthetic_insert_id(when, blank("trace"), blank(url))),
        receive_timestamp=F.col("receiveTimestamp"),
        severity=_severity(),
        log_name=F.coalesce("logName", F.lit("run.googleapis.com/requests")),
        service_name=service,
        resource_type=F.coalesce("resource.type", F.lit("cloud_run_revision")),
        resource_labels=_json("resource.labels"),
        trace_id=_trace(null_safe, service),
        span_id=synthetic_span_id("spanId", when, blank(url)),
        trace_sampled=F.col("traceSampled"),
        json_payload=_json("httpRequest"),
        display_message=F.concat(F.coalesce("httpRequest.requestMethod", F.lit("GET")), F.lit(" "), F.coalesce(url, F.lit("/"))),
    )


def varlog_system(df: DataFrame, null_safe: bool = False) -> DataFrame:
    service, when = F.col("resource.labels.service_name"), ts_text("timestamp")
    return _project(
        df,
        "run_googleapis_com_varlog_system",
        insert_id=synthetic_insert_id(when, blank("trace"), blank("textPayload"), blank(service)),
        severity=_severity(),
        log_name=F.lit("run.googleapis.com/varlog/system"),
        service_name=service,
        resource_type=F.coalesce("resource.type", F.lit("cloud_run_revision")),
        resource_labels=_json("resource.labels"),
        trace_id=_trace(null_safe, service),
        span_id=synthetic_span_id("spanId", when, blank("textPayload")),
        text_payload=F.col("textPayload"),
        json_payload=F.lit("{}"),
        display_message=F.col("textPayload"),
    )


def syslog(df: DataFrame, null_safe: bool = False) -> DataFrame:
    when, payload = ts_text("timestamp"), _json("jsonPayload")
    return _project(
        df,
        "syslog",
        insert_id=synthetic_insert_id(when, blank("trace"), blank("spanId"), blank("textPayload")),
        severity=_severity(),
        log_name=F.lit("syslog"),
        service_name=F.lit("compute"),
        resource_type=F.lit("global"),
        resource_labels=F.lit("{}"),
        trace_id=synthetic_trace_id("trace", F.lit("compute"), minute_text("timestamp")),
        span_id=synthetic_span_id("spanId", when, blank("textPayload")),
        text_payload=F.col("textPayload"),
        json_payload=F.coalesce(payload, F.lit("{}")) if null_safe else payload,
        display_message=F.col("textPayload"),
    )


def build_logs(df: DataFrame, null_safe: bool = False) -> DataFrame:
    build, when = blank("resource.labels.build_id"), ts_text("timestamp")
    return _project(
        df,
        "cloudbuild",
        insert_id=F.coalesce("insertId", synthetic_insert_id(when, blank("textPayload"), build)),
        receive_timestamp=F.col("receiveTimestamp"),
        severity=_severity(),
        log_name=F.coalesce("logName", F.lit("cloudbuild")),
        service_name=F.lit("cloudbuild"),
        resource_type=F.coalesce("resource.type", F.lit("build")),
        resource_labels=_json("resource.labels"),
        trace_id=synthetic_trace_id("trace", F.lit("cloudbuild"), minute_text("timestamp"), build),
        span_id=synthetic_span_id("spanId", when, build),
        trace_sampled=F.col("traceSampled"),
        text_payload=F.col("textPayload"),
        json_payload=F.to_json(F.struct(build.alias("build_id"))),
        display_message=F.col("textPayload"),
    )


def error_insights(df: DataFrame, null_safe: bool = False) -> DataFrame:
    insight = "jsonpayload_v1beta1_insight"
    return _project(
        df,
        "clouderrorreporting_googleapis_com_insights",
        insert_id=F.col("insertId"),
        receive_timestamp=F.col("receiveTimestamp"),
        severity=_severity("ERROR"),
        log_name=F.col("logName"),
        service_name=F.coalesce("resource.labels.project_id", F.lit("error-reporting")),
        resource_type=F.coalesce("resource.type", F.lit("global")),
        resource_labels=_json("resource.labels"),
        trace_id=synthetic_trace_id("trace", blank("insertId"), minute_text("timestamp")),
        span_id=synthetic_span_id("spanId", F.coalesce("insertId", ts_text("timestamp"))),
        trace_sampled=F.col("traceSampled"),
        text_payload=F.col("textPayload"),
        json_payload=_json(insight),
        display_message=F.coalesce(
            f"{insight}.message", f"{insight}.exceptioninfo.message", f"{insight}.errorevent.message", "textPayload", F.lit("Error Reporting Insight")
        ),
    )


def scheduler_runs(df: DataFrame, null_safe: bool = False) -> DataFrame:
    started, finished = "jsonpayload_logging_attemptstarted", "jsonpayload_logging_attemptfinished"
    job = F.coalesce(f"{started}.jobname", f"{finished}.jobname")
    what = (
        F.when(F.col(started).isNotNull(), "Started")
        .when(F.col(finished).isNotNull(), F.concat(F.lit("Finished: "), F.coalesce(f"{finished}.status", F.lit("unknown"))))
        .otherwise("Unknown")
    )
    payload = F.coalesce(_json(started), _json(finished))
    return _project(
        df,
        "cloudscheduler_googleapis_com_executions",
        insert_id=F.col("insertId"),
        receive_timestamp=F.col("receiveTimestamp"),
        severity=_severity(),
        log_name=F.col("logName"),
        service_name=F.coalesce(F.col("resource.labels.job_id"), job, F.lit("cloud-scheduler")),
        resource_type=F.coalesce("resource.type", F.lit("cloud_scheduler_job")),
        resource_labels=_json("resource.labels"),
        trace_id=synthetic_trace_id("trace", blank("insertId"), minute_text("timestamp")),
        span_id=synthetic_span_id("spanId", F.coalesce("insertId", ts_text("timestamp"))),
        trace_sampled=F.col("traceSampled"),
        text_payload=F.col("textPayload"),
        json_payload=F.coalesce(payload, F.lit("{}")) if null_safe else payload,
        display_message=F.concat(F.lit("Job: "), F.coalesce(job, F.lit("unknown")), F.lit(" - "), what),
    )


MAPPINGS: dict[str, Callable[..., DataFrame]] = {
    "activity": admin_activity,
    "data_access": data_access,
    "system_event": system_event,
    "stdout": container_stdout,
    "stderr": container_stderr,
    "requests": http_requests,
    "varlog": varlog_system,
    "syslog": syslog,
    "build": build_logs,
    "insights": error_insights,
    "scheduler": scheduler_runs,
}


def canonical(raw: dict[str, DataFrame]) -> DataFrame:
    """All given sinks on the 19-column contract."""
    return reduce(DataFrame.unionByName, [MAPPINGS[name](df) for name, df in raw.items()])


def canonical_reduced(raw: dict[str, DataFrame]) -> DataFrame:
    """The 13-column variant whose trace ids survive a missing service name."""
    return reduce(DataFrame.unionByName, [MAPPINGS[name](df, null_safe=True).select(*REDUCED_COLUMNS) for name, df in raw.items()])


def with_time(mapped: DataFrame) -> DataFrame:
    """A single mapping in its stand-alone form, which leaves out rows without a timestamp."""
    return mapped.filter(F.col("event_timestamp").isNotNull())


LEGACY_SOURCES = {"activity": "cloudaudit_activity", "stdout": "run_stdout", "stderr": "run_stderr", "syslog": "syslog"}


def canonical_v1(raw: dict[str, DataFrame]) -> DataFrame:
    """The four-source legacy view with one message to display."""
    parts = []
    for name, table in LEGACY_SOURCES.items():
        df = raw[name]
        resource = df.schema["resource"].dataType if "resource" in df.columns else None
        label_type = resource["labels"].dataType if resource is not None else None
        known = label_type.fieldNames() if isinstance(label_type, T.StructType) else []

        def label(key: str, known: list[str] = known) -> Column:
            return F.col(f"resource.labels.{key}") if key in known else F.lit(None).cast("string")

        audit = name == "activity"
        service = {"activity": F.coalesce(label("service_name"), label("module_id"), F.lit("")), "syslog": F.lit("")}.get(name, label("service_name"))
        parts.append(
            df.select(
                F.col("timestamp").alias("event_ts"),
                F.col("receiveTimestamp").alias("receive_ts"),
                F.lit(table).alias("source_table"),
                (F.col("resource.type") if resource is not None else F.lit(None).cast("string")).alias("resource_type"),
                label("project_id").alias("project_id"),
                service.alias("service"),
                "severity",
                "trace",
                "spanId",
                (F.col("protoPayload.methodName") if audit else F.lit("")).alias("operation"),
                (F.lit("") if audit else F.col("textPayload")).alias("message"),
                _json("protoPayload" if audit else "jsonPayload").alias("json_payload_str"),
                (_json("labels") if "labels" in df.columns else F.lit(None).cast("string")).alias("labels_json"),
            )
        )
    union = reduce(DataFrame.unionByName, parts)
    shown = F.coalesce(
        first_present("message"), json_field("json_payload_str", "message"), json_field("json_payload_str", "msg"), F.lit("No message content")
    )
    return union.withColumn("display_message", shown).drop("message")


# --- source catalog and schema inventory ------------------------------------------------------------------------------


def catalog_upsert(target: DataFrame, source: DataFrame, keys: tuple[str, ...] = ("source_dataset", "source_table")) -> DataFrame:
    """Rows of the source replace or join those of the target by key; other target rows stay."""
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return kept.unionByName(source)


def schema_inventory(tables: dict[str, DataFrame], partition_by: str | None = None, cluster_by: tuple[str, ...] = (), counts: bool = False) -> DataFrame:
    """One row per (table, column): type, nullability and layout role, from metadata; ``counts`` adds the rows of each table."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, f.name, f.dataType.simpleString(), "NULLABLE" if f.nullable else "REQUIRED", f.name == partition_by, f.name in cluster_by)
        for name, df in sorted(tables.items())
        for f in df.schema.fields
    ]
    fields = "table_name string, column_name string, data_type string, mode string, is_partition boolean, is_cluster boolean"
    inventory = spark.createDataFrame(rows, fields)
    if not counts:
        return inventory
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, df in sorted(tables.items())]
    return inventory.join(reduce(DataFrame.unionByName, parts), "table_name")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns that were added, dropped or changed between two inventories."""
    b = before.select("table_name", "column_name", F.col("data_type").alias("old_type"))
    a = after.select("table_name", "column_name", F.col("data_type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "add").when(F.col("new_type").isNull(), "drop").when(F.col("old_type") != F.col("new_type"), "alter")
    )
    return b.join(a, ["table_name", "column_name"], "full_outer").withColumn("change_type", change).filter(F.col("change_type").isNotNull())


def schema_changelog(diff: DataFrame, version: str, applied_at: str, applied_by: str) -> DataFrame:
    """Change-log rows for an inventory difference."""
    return diff.select(
        F.lit(version).alias("change_version"),
        "change_type",
        F.lit("table").alias("object_type"),
        F.concat_ws(".", "table_name", "column_name").alias("object_name"),
        F.lit(applied_at).cast("timestamp").alias("applied_at"),
        F.lit(applied_by).alias("applied_by"),
        F.concat_ws(" -> ", "old_type", "new_type").alias("description"),
    )
