"""Named queries: text layouts, chunking, hashing, embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.operators import normalize as n
from lumenlog.operators import textprep as t
from lumenlog.plans.oracle_views import js, level_sql, log_type_sql
from lumenlog.plans.registry import query
from lumenlog.plans.shapes import documents, unified


# The packing rules as a recursion over the pieces of each text.
CHUNKS = r"""WITH RECURSIVE s AS (SELECT doc_id, source, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents WHERE length(text) > 4000),
    u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS si FROM s),
    w AS (SELECT doc_id, si, length(part) + 1 > 4000 AS long, CASE WHEN length(part) + 1 > 4000 THEN string_split_regex(part, '\s+') ELSE [part] END AS pieces FROM u),
    v AS (SELECT doc_id, si, long, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS wi FROM w),
    p AS (SELECT doc_id, piece, long AND wi = 1 AS fresh, length(piece) + 1 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY si, wi) AS i FROM v),
    r AS (SELECT doc_id, i, piece, n AS size, 0 AS chunk FROM p WHERE i = 1
          UNION ALL SELECT p.doc_id, p.i, p.piece, CASE WHEN NOT p.fresh AND r.size + p.n <= 4000 THEN r.size + p.n ELSE p.n END, CASE WHEN NOT p.fresh AND r.size + p.n <= 4000 THEN r.chunk ELSE r.chunk + 1 END
          FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
    g AS (SELECT doc_id, chunk, string_agg(piece, ' ' ORDER BY i) AS chunk_text FROM r GROUP BY ALL),
    c AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_idx, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, chunk_text FROM g
          UNION ALL SELECT doc_id, 0, 1, text FROM documents WHERE length(text) <= 4000),
    chunk_rows AS (SELECT doc_id, CASE WHEN total_chunks > 1 THEN doc_id || '_chunk_' || chunk_idx ELSE CAST(doc_id AS VARCHAR) END AS chunk_id, chunk_idx, total_chunks, chunk_text FROM c)"""


@query("chunk_text", CHUNKS + " SELECT * FROM chunk_rows")
def _(c):
    return t.chunk_rows(documents(c).select("doc_id", "text"), "doc_id", "text").select("doc_id", "chunk_id", "chunk_idx", "total_chunks", "chunk_text")


@query("chunk_ids", CHUNKS + " SELECT chunk_id, chunk_idx, total_chunks FROM chunk_rows")
def _(c):
    return t.chunk_rows(documents(c).select("doc_id", "text"), "doc_id", "text").select("chunk_id", "chunk_idx", "total_chunks")


@query("embedding_text", "SELECT doc_id, CASE WHEN text <> '' AND source <> '' THEN 'Message: ' || text || ' | Body: ' || source WHEN text <> '' THEN 'Message: ' || text WHEN source <> '' THEN 'Body: ' || source ELSE 'empty log' END AS embedding_text FROM documents")
def _(c):
    return documents(c).select("doc_id", t.embedding_text("text", "source").alias("embedding_text"))


ISO = "CASE WHEN epoch_us(event_timestamp) % 1000000 = 0 THEN strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S') ELSE strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') END"
LABELS = f"CASE WHEN json_valid(labels) THEN 'Labels: env=' || {js('labels', 'env')} || ' tenant_id=' || {js('labels', 'tenant_id')} || ' request_id=' || {js('labels', 'request_id')} END"
RESOURCE = f"'ResourceLabels: project_id=' || {js('resource_labels', 'project_id')} || ' region=' || {js('resource_labels', 'region')} || ' zone=' || {js('resource_labels', 'zone')} || ' service_name=' || {js('resource_labels', 'service_name')} || ' job_name=' || {js('resource_labels', 'job_name')} || ' revision_name=' || {js('resource_labels', 'revision_name')}"


@query(
    "trace_text",
    f"""SELECT log_id, concat_ws(' | ', '[' || {ISO} || '] [' || severity || '] [' || service_name || ']', CASE WHEN text_payload <> '' THEN 'Message: ' || text_payload END,
        CASE WHEN json_payload <> '' THEN 'JSON: ' || json_payload END, CASE WHEN proto_payload <> '' THEN 'Proto: ' || proto_payload END,
        CASE WHEN trace_id <> '' THEN 'Trace: ' || trace_id END, CASE WHEN trace_id <> '' AND span_id <> '' THEN 'Span: ' || span_id END,
        CASE WHEN http_method <> '' AND http_url <> '' THEN 'HTTP: ' || http_method || ' ' || http_url || ' ' || coalesce(CAST(http_status AS VARCHAR), '') END,
        CASE WHEN source_file <> '' THEN 'Source: ' || source_file || ':' || coalesce(CAST(source_line AS VARCHAR), '') END, {LABELS},
        'Resource: ' || coalesce(resource_type, ''), {RESOURCE}) AS text FROM o_normal""",
)
def _(c):
    rows = unified(c)
    return rows.select("log_id", t.trace_text(rows).alias("text"))


@query(
    "master_log_text",
    f"""SELECT log_id, concat_ws(' ', '[' || {ISO} || '] [' || severity || ']', CASE WHEN service_name <> '' THEN '[' || service_name || ']' END, CASE WHEN resource_type <> '' THEN '[' || resource_type || ']' END,
        CASE WHEN message <> '' THEN 'Message: ' || message END, CASE WHEN text_payload <> '' AND text_payload IS DISTINCT FROM message THEN 'Text: ' || text_payload END,
        CASE WHEN json_payload <> '' THEN 'JSON: ' || json_payload END,
        CASE WHEN http_method <> '' OR http_url <> '' THEN concat_ws(' ', 'HTTP:', nullif(http_method, ''), nullif(http_url, ''), CASE WHEN http_status <> 0 THEN 'status=' || http_status END) END,
        CASE WHEN trace_id <> '' THEN 'Trace: ' || trace_id END) AS text FROM o_normal""",
)
def _(c):
    return unified(c).select("log_id", t.master_log_text().alias("text"))


@query(
    "vector_payload",
    f"""SELECT log_id, {ISO} AS iso, CAST(year(event_timestamp) AS INTEGER) AS year, CAST(month(event_timestamp) AS INTEGER) AS month, CAST(day(event_timestamp) AS INTEGER) AS day,
        CAST(hour(event_timestamp) AS INTEGER) AS hour, severity, coalesce(service_name, 'unknown') AS service_name, coalesce(resource_type, 'unknown') AS resource_type, source_table, trace_id, span_id,
        substr(coalesce(message, ''), 1, 500) AS preview, coalesce(json_payload, '') <> '' AS has_json, coalesce(http_method, '') <> '' AS has_http_request FROM o_normal""",
)
def _(c):
    return t.vector_payload(unified(c)).select("log_id", "timestamp.*", "severity", "service_name", "resource_type", "source_table", "trace_id", "span_id", "preview", "has_json", "has_http_request")


@query(
    "paragraph_chunks",
    r"""WITH p AS (SELECT 'doc-' || doc_id || '.txt' AS file_path, string_split(text, chr(10) || chr(10)) AS parts FROM documents),
        c AS (SELECT file_path, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM p),
        u AS (SELECT file_path, unnest(parts) AS chunk, generate_subscripts(parts, 1) - 1 AS i FROM c)
        SELECT md5(file_path || '-latest-' || i) AS point_id, file_path, 'latest' AS commit_hash, CAST(i AS INTEGER) AS chunk_index, chunk,
        CASE WHEN length(chunk) > 200 THEN substr(chunk, 1, 200) || '...' ELSE chunk END AS content_preview FROM u""",
)
def _(c):
    files = documents(c).select(F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("file"), "text")
    return t.paragraph_chunks(files, "file", "text")


@query("embed")
def _(c):
    return t.embed(documents(c).select("doc_id", "text"), "text", dim=64).select("doc_id", "embedding")


@query(
    "text_hash",
    """SELECT source, sha256(text) AS text_hash, min(doc_id) AS doc_id FROM documents GROUP BY ALL""",
)
def _(c):
    return t.dedup_by_text(documents(c).select("source", "doc_id", "text"), "source", "text", "doc_id").select("source", "text_hash", "doc_id")


@query(
    "text_hash_incremental",
    """SELECT source, sha256(text) AS text_hash, min(doc_id) AS doc_id FROM documents WHERE (source, sha256(text)) NOT IN (SELECT (source, sha256(text)) FROM documents WHERE lang = 'en') GROUP BY ALL""",
)
def _(c):
    docs = documents(c).select("source", "doc_id", "text", "lang")
    stored = docs.filter("lang = 'en'").select("source", t.text_hash("text").alias("text_hash"))
    return t.dedup_by_text(docs.drop("lang"), "source", "text", "doc_id", stored).select("source", "text_hash", "doc_id")


@query(
    "enrich_undecided",
    f"""WITH q AS (SELECT log_id, message, {log_type_sql('source_table')} AS log_type, {level_sql('severity')} >= 500 AS e, contains(source_table, 'audit') AS a, contains(source_table, 'request') AS r FROM logs)
        SELECT log_id, CASE WHEN a THEN 'audit' WHEN e THEN 'error' WHEN r THEN 'request' WHEN contains(message, 'counter') THEN 'performance' ELSE 'application' END AS message_category FROM q""",
)
def _(c):
    def keyword_scorer(texts: list[str]) -> list[tuple[str, str]]:
        """Stand-in for a model: deterministic category and summary."""
        return [("performance" if "counter" in x else "application", x[:60]) for x in texts]

    flags = n.flags("source_table", n.severity_level("severity"), "trace_id")
    open_category = F.when(flags["is_audit"], "audit").when(flags["is_error"], "error").when(flags["is_request"], "request")
    rows = c.logs.select("log_id", "message", open_category.alias("message_category"), F.lit(None).cast("string").alias("message_summary"))
    return t.enrich_undecided(rows, keyword_scorer, "message_category").select("log_id", "message_category")
