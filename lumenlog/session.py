"""Session settings and the shared folder for materialised intermediate results."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
_collecting: ContextVar[list[str] | None] = ContextVar("_collecting", default=None)


def build_session(app_name: str = "lumenlog", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every job here relies on; cluster settings win where they are given."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting (tests, a laptop) gets a temporary folder, remembered in the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lumenlog.scratch.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="lumenlog-")
    spark.conf.set("lumenlog.scratch.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/lumenlog/{label}-{uuid.uuid4().hex}"
    if (made := _collecting.get()) is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def collected_scratch() -> Iterator[list[str]]:
    """The scratch paths handed out in the block, for a job that removes them once its result is stored elsewhere."""
    made: list[str] = []
    token = _collecting.set(made)
    try:
        yield made
    finally:
        _collecting.reset(token)


def remove_scratch(spark: SparkSession, paths: list[str], keep: DataFrame) -> list[str]:
    """Delete scratch folders, except those that ``keep`` still reads; returns these."""
    read = keep.inputFiles() if paths else []
    left = []
    for path in paths:
        if any(f"/{path.rpartition('/')[2]}/" in file for file in read):
            left.append(path)
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return left


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows. They come as an Arrow table: rows as Python objects would pass through Python workers of their own
    kind, which stay in the executors' memory beside those that do the work."""
    fields = StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [[]] * len(fields)
    table = pa.table({f.name: pa.array(list(c), _ARROW[f.dataType.simpleString()]) for f, c in zip(fields, columns)})
    return spark.createDataFrame(table, fields)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and freezes values that must not be computed twice (row positions after a global sort).
    The files outlive any executor, so a lost executor only costs a re-read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(df: DataFrame, piece_bytes: int, most: int = 64) -> int:
    """How many pieces keep the cores busy and none much above ``piece_bytes`` of its input's files."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(min(df.sparkSession.sparkContext.defaultParallelism, most), -(-stored // piece_bytes))


def widen(df: DataFrame, key: str, most: int = 64, piece_bytes: int | None = None) -> DataFrame:
    """Spread an input that arrives in fewer pieces than there are cores, before work that is heavy per row.

    A single small file would otherwise keep one core busy with all the parsing. An input with enough pieces is returned as
    it is, so a large table is never shuffled for this, unless ``piece_bytes`` bounds the pieces of a table of narrow rows.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, most) if piece_bytes is None else pieces(df, piece_bytes, most)
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df
