"""Text layouts, chunking, hashing and embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.columns import cap, col

BAR = " | "
CHUNK_SIZE = 4000
EMBED_DIM = 256
TRUNCATED = "... [truncated]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chunks(text: str | Column, max_size: int = CHUNK_SIZE) -> Column:
    """Split a text into chunks of at most ``max_size`` characters, at sentence ends where possible.

    Sentences are packed greedily; one that is too long for a chunk of its own is packed word by word instead, and its last
    piece goes on filling up with the sentences after it. The packing is one fold over the pieces, inside the JVM.
    """
    text = col(text)
    limit = F.lit(max_size)
    sentences = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), _strip), lambda s: s != "")

    def pieces(s: Column) -> Column:
        words = F.split(s, r"(?U)\s+")
        by_word = F.transform(words, lambda w, i: F.struct(w.alias("text"), (i == 0).alias("fresh")))
        whole = F.array(F.struct(s.alias("text"), F.lit(False).alias("fresh")))
        return F.when(F.length(s) + 1 > limit, by_word).otherwise(whole)

    def pack(state: Column, piece: Column) -> Column:
        size = F.length(piece["text"]) + 1
        fits = ~piece["fresh"] & (state["size"] + size <= limit)
        flushed = F.when(state["size"] == 0, state["done"]).otherwise(F.concat(state["done"], F.array(_strip(state["current"]))))
        return F.struct(
            F.when(fits, state["done"]).otherwise(flushed).alias("done"),
            F.when(fits, F.concat(state["current"], piece["text"], F.lit(" "))).otherwise(F.concat(piece["text"], F.lit(" "))).alias("current"),
            F.when(fits, state["size"] + size).otherwise(size).alias("size"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["size"] == 0, state["done"]).otherwise(F.concat(state["done"], F.array(_strip(state["current"]))))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"), F.lit(0).alias("size"))
    packed = F.aggregate(F.flatten(F.transform(sentences, pieces)), start, pack, finish)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def chunk_rows(df: DataFrame, id_column: str, text: str | Column, max_size: int = CHUNK_SIZE) -> DataFrame:
    """One row per chunk. The id gets a suffix only when there is more than one chunk."""
    parts = df.withColumn("_chunks", chunks(text, max_size)).withColumn("total_chunks", F.size("_chunks"))
    rows = parts.select(*df.columns, "total_chunks", F.posexplode("_chunks").alias("chunk_idx", "chunk_text"))
    base = F.col(id_column).cast("string")
    return rows.withColumn("chunk_id", F.when(F.col("total_chunks") > 1, F.concat(base, F.lit("_chunk_"), F.col("chunk_idx").cast("string"))).otherwise(base))


def embedding_text(message: str | Column, body: str | Column) -> Column:
    def part(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))

    return F.coalesce(F.nullif(F.concat_ws(BAR, part("Message", col(message)), part("Body", col(body))), F.lit("")), F.lit("empty log"))


def _iso(ts: str) -> Column:
    """Timestamp in ISO form, with microseconds only where there are any."""
    t = F.col(ts).cast("timestamp")
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(t) % 1_000_000 == 0, whole).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _present(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def _pairs(json: str) -> Column:
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def trace_text(df: DataFrame) -> Column:
    """The labelled one-line layout of a unified row, with whole payloads and all labels; long texts are left to chunking."""

    def labelled(label: str, c: str) -> Column:
        return F.when(_present(c), F.concat(F.lit(f"{label}: "), c))

    head = F.concat(F.lit("["), F.coalesce(_iso("event_timestamp"), F.lit("unknown_time")), F.lit("] ["), "severity", F.lit("] ["), "service_name", F.lit("]"))
    http = F.concat(F.lit("HTTP: "), "http_method", F.lit(" "), "http_url", F.lit(" "), F.coalesce(F.col("http_status").cast("string"), F.lit("")))
    source = F.concat(F.lit("Source: "), "source_file", F.lit(":"), F.coalesce(F.col("source_line").cast("string"), F.lit("")))
    parts = F.concat_ws(
        BAR,
        head,
        labelled("Message", "text_payload"),
        labelled("JSON", "json_payload"),
        labelled("Proto", "proto_payload"),
        F.when(_present("trace_id"), F.concat(F.lit("Trace: "), "trace_id")),
        F.when(_present("trace_id") & _present("span_id"), F.concat(F.lit("Span: "), "span_id")),
        F.when(_present("http_method") & _present("http_url"), http),
        F.when(_present("source_file"), source),
        F.when(_present("labels") & F.from_json("labels", "map<string,string>").isNotNull(), F.concat(F.lit("Labels: "), _pairs("labels"))),
        F.concat(F.lit("Resource: "), F.coalesce("resource_type", F.lit(""))),
        F.when(_present("resource_labels"), F.concat(F.lit("ResourceLabels: "), _pairs("resource_labels"))),
    )
    return parts


def master_log_text() -> Column:
    """The second layout, space joined."""
    extra = _present("text_payload") & ~F.col("text_payload").eqNullSafe(F.col("message"))
    http = F.concat_ws(
        " ", F.lit("HTTP:"), F.when(_present("http_method"), F.col("http_method")), F.when(_present("http_url"), F.col("http_url")),
        F.when(F.coalesce("http_status", F.lit(0)) != 0, F.concat(F.lit("status="), F.col("http_status").cast("string"))),
    )
    return F.concat_ws(
        " ",
        F.concat(F.lit("["), F.coalesce(_iso("event_timestamp"), F.lit("unknown")), F.lit("] ["), "severity", F.lit("]")),
        F.when(_present("service_name"), F.concat(F.lit("["), "service_name", F.lit("]"))),
        F.when(_present("resource_type"), F.concat(F.lit("["), "resource_type", F.lit("]"))),
        F.when(_present("message"), F.concat(F.lit("Message: "), "message")),
        F.when(extra, F.concat(F.lit("Text: "), "text_payload")),
        F.when(_present("json_payload"), F.concat(F.lit("JSON: "), "json_payload")),
        F.when(_present("http_method") | _present("http_url"), http),
        F.when(_present("trace_id"), F.concat(F.lit("Trace: "), "trace_id")),
    )


def vector_payload(df: DataFrame) -> DataFrame:
    """What is stored next to a vector: time hierarchy, 500-character preview, payload flags."""
    ts = F.col("event_timestamp")
    time = F.struct(_iso("event_timestamp").alias("iso"), F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"))
    return df.select(
        "log_id",
        time.alias("timestamp"),
        "severity",
        F.coalesce("service_name", F.lit("unknown")).alias("service_name"),
        F.coalesce("resource_type", F.lit("unknown")).alias("resource_type"),
        "source_table",
        "trace_id",
        "span_id",
        F.substring(F.coalesce("message", F.lit("")), 1, 500).alias("preview"),
        _present("json_payload").alias("has_json"),
        _present("http_method").alias("has_http_request"),
    )


# Files the code index leaves out.
SKIPPED_FILES = [".pyc", ".log", ".md", ".json"]


def paragraph_chunks(df: DataFrame, file: str, text: str, commit: str = "latest") -> DataFrame:
    """Paragraphs of files with a 200-character preview and a key of (file, commit, index)."""
    kept = df.filter(~F.col(file).rlike("(" + "|".join(e.replace(".", r"\.") for e in SKIPPED_FILES) + ")$"))
    parts = F.filter(F.transform(F.split(F.col(text), "\n\n"), _strip), lambda p: p != "")
    rows = kept.select(F.col(file).alias("file_path"), F.posexplode(parts).alias("chunk_index", "chunk"))
    key = F.concat_ws("-", "file_path", F.lit(commit), F.col("chunk_index").cast("string"))
    return rows.select(
        F.md5(key).alias("point_id"), "file_path", F.lit(commit).alias("commit_hash"), "chunk_index", "chunk", cap("chunk", 200).alias("content_preview")
    )


def text_hash(text: str | Column) -> Column:
    return F.sha2(col(text), 256)


def dedup_by_text(df: DataFrame, tenant: str, text: str, order: str, stored: DataFrame | None = None) -> DataFrame:
    """First row of each distinct text within a tenant, leaving out texts that are stored already.

    The aggregate keeps one row per (tenant, hash) inside each task, so a text with very many copies shuffles next to nothing.
    """
    hashed = df.withColumn("text_hash", text_hash(text))
    if stored is not None:
        hashed = hashed.join(stored.select(tenant, "text_hash").distinct(), [tenant, "text_hash"], "left_anti")
    rest = [c for c in hashed.columns if c not in (tenant, "text_hash")]
    first = hashed.groupBy(tenant, "text_hash").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(tenant, "text_hash", "_row.*")


def embed(df: DataFrame, text: str, dim: int = EMBED_DIM, out: str = "embedding") -> DataFrame:
    """Deterministic hashed bag-of-words vectors of unit length; blank texts get none. Runs in the JVM."""
    words = F.filter(F.split(F.lower(F.col(text)), r"(?U)[^\w]+"), lambda w: w != "")
    tokens = df.withColumn("_tokens", F.coalesce(words, F.array().cast("array<string>")))
    counted = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_counts").transform(tokens)
    scaled = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    vector = F.when(F.size("_tokens") > 0, vector_to_array("_unit", "float32"))
    return scaled.withColumn(out, vector).drop("_tokens", "_counts", "_unit")


def embed_with(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """Vectors from an external model, called once per Arrow batch of texts; blank texts get none."""

    @F.pandas_udf("array<float>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            filled = texts.fillna("").str.strip() != ""
            vectors = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if filled.any():
                vectors[filled] = pd.Series(model(texts[filled].tolist()), index=texts.index[filled])
            yield vectors

    return df.withColumn(out, call(text))


def enrich_undecided(df: DataFrame, scorer: Callable[[list[str]], list[tuple[str, str]]], category: str, text: str = "message") -> DataFrame:
    """Ask a batch scorer for (category, summary) of the rows the rules left open; the others never reach Python."""
    decided, open_rows = df.filter(F.col(category).isNotNull()), df.filter(F.col(category).isNull())

    @F.pandas_udf("category string, summary string")
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(scorer(texts.fillna("").tolist()), columns=["category", "summary"])

    scored = open_rows.withColumn("_scored", score(text)).withColumns({category: F.col("_scored.category"), "message_summary": F.col("_scored.summary")})
    return decided.unionByName(scored.drop("_scored"))
