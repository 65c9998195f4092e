"""The whole load: raw sinks to the unified table, and documents to stored vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators import normalize, textprep
from lumenlog.session import materialize
from lumenlog.sources import io, merge_table


def records_of(sinks: dict[str, DataFrame], dataset: str, start: str | None = None) -> DataFrame:
    """All sinks as raw records, optionally only rows since ``start``; one lazy plan, whatever the number of sinks."""
    parts = []
    for table, df in sinks.items():
        rows = df if start is None else df.filter(F.col("timestamp") >= F.lit(start).cast(df.schema["timestamp"].dataType))
        parts.append(io.to_raw_record(io.scan_source(rows), dataset, table))
    return reduce(DataFrame.unionByName, parts)


def unified(records: DataFrame) -> DataFrame:
    """Raw records as classified unified rows, one of each."""
    return normalize.classify_or_other(normalize.normalize_logs(records))


def load(sinks: dict[str, DataFrame], dataset: str, target: str, batch_id: str, loaded_at: str, start: str | None = None) -> None:
    """Extract, normalise, classify and append; rows already stored are left alone, so a re-run changes nothing.

    A full load passes no ``start``; an incremental one passes the start of its look-back window.
    """
    io.append_logs(records_of(sinks, dataset, start), target, batch_id, loaded_at, shape=unified)


JOBS = "job_id string, run int, mode string, stream_id string, status string, extracted bigint, loaded bigint, error string, seq int"
MODES = ("full", "incremental", "stream", "cleanup")


def _record(spark: SparkSession, jobs: str, rows: list[tuple], number: int) -> None:
    """Job rows of one run: one for each stream and one for the run."""
    merge_table.upsert(spark.createDataFrame(rows, JOBS), jobs, "job_id", "seq", number, "etl", buckets=8)


def job_rows(spark: SparkSession, jobs: str) -> DataFrame:
    """The latest state of every job."""
    return merge_table.read(spark, jobs, "job_id", "seq")


def _opened(sources: dict[str, Callable[[], DataFrame]], dataset: str, start: str | None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Raw records of the sources that can be read, and what is wrong with the others."""
    found, broken = {}, {}
    for name, source in sources.items():
        try:
            found[name] = records_of({name: source()}, dataset, start)
        except (AnalysisException, KeyError) as e:
            broken[name] = str(e).splitlines()[0][:500]
    return found, broken


def run_load(
    spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], dataset: str, target: str, jobs: str, run: int, as_of: str,
    mode: str = "full", hours: float = 24, only: list[str] | None = None, days: int = 30, continue_on_error: bool = True,
) -> str:
    """One load of the sinks named in ``sources``, recorded as job rows; returns its status.

    ``full`` takes everything, ``incremental`` the last ``hours``, ``stream`` the sinks named in ``only``; ``cleanup`` counts what is
    older than ``days`` in the sources and loads nothing. All sinks go through one plan; rows that came are counted while their ids are read, and
    rows that were added while they are written. A sink that cannot be opened is FAILED and the others are loaded, which makes the run PARTIAL; without
    ``continue_on_error`` it, or any error of the load itself, makes the run FAILED. ``run`` counts upwards.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    chosen = {n: s for n, s in sources.items() if mode != "stream" or n in (only or [])}

    def row(name: str | None, status: str, extracted=None, loaded=None, error=None, seq: int = 1) -> tuple:
        stream = None if name is None else f"{dataset}.{name}"
        return (f"{run}/{stream or 'run'}", run, mode, stream, status, extracted, loaded, error, seq)

    _record(spark, jobs, [row(n, "RUNNING", seq=0) for n in [*chosen, None]], 2 * run)
    ago = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days if mode == "cleanup" else 0), F.lit(hours if mode == "incremental" else 0).cast("int"))
    start = str(spark.range(1).select(ago.cast("string")).first()[0])
    found, broken = _opened(chosen, dataset, start if mode == "incremental" else None)
    rows = [row(n, "FAILED", error=e) for n, e in broken.items()]
    if broken and not continue_on_error:
        _record(spark, jobs, rows + [row(n, "FAILED", error="not tried") for n in found] + [row(None, "FAILED", error=next(iter(broken.values())))], 2 * run + 1)
        return "FAILED"
    extracted, loaded = Observation(), Observation()
    counts = [F.count_if(F.col("stream_id") == f"{dataset}.{n}").alias(n) for n in found]
    try:
        if found:
            records = reduce(DataFrame.unionByName, found.values())
            if mode == "cleanup":
                old = records.filter(F.col("event_timestamp") < F.lit(start).cast("timestamp")).agg(*counts).first().asDict()
                came, added = old, {n: 0 for n in found}
            else:
                io.append_logs(records, target, f"run-{run}", as_of, extracted, loaded, counts, shape=unified)
                came, added = extracted.get, loaded.get
            rows += [row(n, "COMPLETED", came[n], added[n]) for n in found]
        status = "PARTIAL" if broken else "COMPLETED"
    except Exception as e:
        failed = [row(n, "FAILED", error=str(e)[:500]) for n in found]
        _record(spark, jobs, rows + failed + [row(None, "FAILED", error=str(e)[:500])], 2 * run + 1)
        raise
    total = [sum(r[k] or 0 for r in rows) for k in (5, 6)]
    _record(spark, jobs, rows + [row(None, status, *total, error=next(iter(broken.values()), None))], 2 * run + 1)
    return status


def embed_documents(
    docs: DataFrame, target: str, batch: int, tenant: str = "source", dim: int = 64, max_size: int = textprep.CHUNK_SIZE, deleted: DataFrame | None = None
) -> bool:
    """Chunk, embed and store the documents of a batch, each as a whole: what a document's stored chunks have too many goes.

    ``batch`` counts upwards and is the version of what it writes; a batch that was applied is passed over (False). Texts are trimmed,
    and a document without a text, or whose id is in ``deleted`` (a column ``doc_id``), keeps no chunk; rows without an id are left out.
    If a batch has several texts for a document one of them is taken, the same one on every run. Chunks whose text is stored already
    are left alone, and a text that several chunks share is embedded once. Read the table with ``documents_table``.

    What is new is told from keys and hashes; of the texts only one copy of each is moved, once, to be embedded.
    """
    spark: SparkSession = docs.sparkSession
    if batch <= merge_table.manifest(spark, target)["applied"].get("documents", -1):
        return False
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", tenant, F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("text"))
    several = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max(F.xxhash64("text")).alias("_hash")).filter("_n > 1").drop("_n"), "several-texts")
    if not several.isEmpty():
        docs = docs.join(several, "doc_id", "left").filter(F.col("_hash").isNull() | (F.col("_hash") == F.xxhash64("text"))).drop("_hash")
    rows = textprep.chunk_rows(docs.filter("text <> ''"), "doc_id", "text", max_size).drop("text")
    rows = materialize(rows.withColumns({"text_hash": F.sha2("chunk_text", 256), "version": F.lit(batch).cast("long")}), "chunks")
    fresh, gone = rows.drop("chunk_text"), None
    if merge_table.exists(spark, target):
        touched = docs.select("doc_id") if deleted is None else docs.select("doc_id").unionByName(deleted.select("doc_id"))
        stored = documents_table(spark, target, ["chunk_id", "doc_id", "text_hash", "total_chunks"]).join(touched.distinct(), "doc_id", "left_semi")
        stored = materialize(stored, "stored-chunks")
        fresh = fresh.join(stored, ["chunk_id", "text_hash", "total_chunks"], "left_anti")
        gone = stored.join(rows, "chunk_id", "left_anti").select("chunk_id", F.lit(batch).cast("long").alias("version"))
    fresh = materialize(fresh.dropDuplicates(["chunk_id"]), "fresh-chunks")
    texts = rows.groupBy("text_hash").agg(F.first("chunk_text").alias("chunk_text")).filter(F.lower("chunk_text").rlike(r"(?U)\w"))  # others have no vector
    once = textprep.embed(texts.join(fresh, "text_hash", "left_semi"), "chunk_text", dim)
    return merge_table.upsert(fresh.join(once, "text_hash"), target, "chunk_id", "version", batch, "documents", gone)


def documents_table(spark: SparkSession, target: str, columns: list[str] | None = None) -> DataFrame:
    """The chunks that ``embed_documents`` keeps, or some columns of them."""
    return merge_table.read(spark, target, "chunk_id", "version", columns=columns)


def ingest_logs(payload: DataFrame, target: str, quarantine: str, batch: int, allowed: list[str], required: list[str], dim: int = 64) -> bool:
    """Validate, lay out, chunk, embed and store log payloads; rows that break the contract go to ``quarantine`` with their reasons."""
    valid, odd = normalize.split_valid(normalize.validate_payload(payload, allowed, required))
    odd.write.mode("overwrite").parquet(f"{quarantine}/batch={batch}")
    body = F.col("body") if "body" in payload.columns else F.lit(None).cast("string")
    docs = valid.select(F.col("log_id").alias("doc_id"), F.col("service_name").alias("source"), textprep.embedding_text("message", body).alias("text"))
    return embed_documents(docs, target, batch, dim=dim)
