"""Keyed tables that are merged when they are read.

A batch of changes is written as it comes, as files of its own; nothing stored is rewritten. A reader takes the newest version of every
key from the compacted buckets and the batches after them. Compaction folds batches into the buckets they touch, as new files beside
the old ones. Which files count is said by the newest manifest, a small text that is put in place whole, so a reader sees one version
throughout, and what a failed write left behind is in no manifest. ``vacuum`` removes files that no kept manifest names.

One writer at a time is expected; a second one finds its manifest number taken and fails without harm.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.session import pieces

#: Stored bytes of a bucket that are merged in one task.
BUCKET_BYTES = 64 << 20
DELETED = "_deleted"
_EMPTY = {"version": 0, "buckets": 0, "base": {}, "deltas": [], "applied": {}, "schema": None}


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _folder(spark, f"{path}/manifest")
    names = [str(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The newest manifest, or one that is still kept: ``base`` has the folder of each bucket, ``deltas`` the batches not folded in."""
    known = _versions(spark, path)
    if not known:
        return dict(_EMPTY)
    file, fs = _folder(spark, f"{path}/manifest/{known[-1] if version is None else version:012d}.json")
    stream = fs.open(file)
    try:
        return json.loads(bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, new: dict) -> None:
    """Put the manifest of the next version in place: written aside, then renamed, which fails if that version exists."""
    target, fs = _folder(spark, f"{path}/manifest/{new['version']:012d}.json")
    aside, _ = _folder(spark, f"{path}/manifest/.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"another writer has committed version {new['version']} of {path}")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def upsert(changes: DataFrame, path: str, key: str, order: str, batch: int, source: str = "", deletes: DataFrame | None = None, buckets: int = 64) -> bool:
    """Add a batch of changed rows and, from ``deletes`` (key and order), of deletions. False if the batch was there before.

    Batches of a source are numbered upwards, as a stream numbers them; a number that is not above the last one is a repeat and is
    passed over. The number of buckets is chosen when the table is made.
    """
    spark = changes.sparkSession
    now = manifest(spark, path)
    if batch <= now["applied"].get(source, -1):
        return False
    rows = changes.withColumn(DELETED, F.lit(False))
    if deletes is not None:
        rows = rows.unionByName(deletes.select(key, order).withColumn(DELETED, F.lit(True)), allowMissingColumns=True)
    schema = T.StructType.fromJson(json.loads(now["schema"])) if now["schema"] else rows.schema
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    name = f"delta/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    _commit(spark, path, now | {"version": now["version"] + 1, "buckets": now["buckets"] or buckets, "deltas": now["deltas"] + [name], "applied": now["applied"] | {source: batch}, "schema": json.dumps(schema.jsonValue())})
    return True


def _stored(spark: SparkSession, path: str, at: dict, folders: list[str]) -> DataFrame | None:
    """The rows of some folders of the table."""
    schema = T.StructType.fromJson(json.loads(at["schema"]))
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else None


def _hashed(rows: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Some columns of rows, with a hash of all of them but the key."""
    return rows.select(*kept, F.xxhash64(*[c for c in rows.columns if c != key]).alias("_hash"))


def _newest(rows: DataFrame, key: str, order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The row of each key with the highest order; a deletion wins over a change of the same order, then the row's hash decides.

    Columns in ``within`` depend on the key; rows that are placed by them are not moved again.
    """
    rest = [c for c in rows.columns if c not in (key, "_hash", *within)]
    latest = rows.groupBy(*within, key).agg(F.max_by(F.struct(*rest), F.struct(order, DELETED, "_hash")).alias("_row"))
    return latest.select(key, *within, "_row.*").select(*[c for c in rows.columns if c != "_hash"])


def _merged(spark: SparkSession, path: str, at: dict, key: str, order: str, kept: list[str]) -> DataFrame:
    held, changes = _stored(spark, path, at, [*at["base"].values()]), _stored(spark, path, at, at["deltas"])
    if changes is None:
        return held.select(*kept)
    if held is None:
        return _newest(_hashed(changes, key, kept), key, order)
    # Rows whose key no batch has pass by without being moved, as long as the batches' keys are few enough to be sent around.
    keys = changes.select(F.col(key).alias("_key")).distinct()
    same = F.col(key).eqNullSafe(F.col("_key"))
    again = _hashed(held, key, kept).join(keys, same, "left_semi").unionByName(_hashed(changes, key, kept))
    return held.select(*kept).join(keys, same, "left_anti").unionByName(_newest(again, key, order))


def read(spark: SparkSession, path: str, key: str, order: str, version: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The newest version of every key that is not deleted, as of one manifest; with ``columns`` only these of it are moved."""
    at = manifest(spark, path, version)
    if at["schema"] is None:
        raise ValueError(f"no table at {path}")
    names = T.StructType.fromJson(json.loads(at["schema"])).names
    kept = [n for n in names if columns is None or n in (key, order, DELETED, *columns)]
    rows = _merged(spark, path, at, key, order, kept).filter(~F.col(DELETED)).drop(DELETED)
    return rows if columns is None else rows.select(*columns)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def compact(spark: SparkSession, path: str, key: str, order: str) -> None:
    """Fold all batches into the buckets they touch. Deletions stay as marks, so that a late change cannot bring a key back.

    Rows are moved once, to their bucket, or to one of its parts where a bucket is large, and merged there.
    """
    at = manifest(spark, path)
    if not at["deltas"]:
        return
    changes = _stored(spark, path, at, at["deltas"])
    touched = [str(r[0]) for r in changes.select(_bucket(key, at["buckets"])).distinct().collect()]  # at most one row per bucket
    old = [at["base"][b] for b in touched if b in at["base"]]
    rows = _stored(spark, path, at, old + at["deltas"])
    part = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("part")), F.lit(-(-pieces(rows, BUCKET_BYTES) // at["buckets"])))
    placed = _hashed(rows, key, rows.columns).withColumns({"bucket": _bucket(key, at["buckets"]), "part": part}).repartition("bucket", "part")
    merged = _newest(placed, key, order, ("bucket", "part")).drop("part")
    name = f"base/{uuid.uuid4().hex}"
    merged.write.partitionBy("bucket").parquet(f"{path}/{name}")
    base = at["base"] | {b: f"{name}/bucket={b}" for b in touched}
    _commit(spark, path, at | {"version": at["version"] + 1, "base": base, "deltas": []})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove the files that none of the ``keep`` newest manifests names, and the manifests before them; returns what went.

    Readers of older versions must have ended, and no writer may be at work: its files are not in a manifest yet.
    """
    known = _versions(spark, path)
    kept = [manifest(spark, path, v) for v in known[-keep:]]
    named = {f for m in kept for f in [*m["base"].values(), *m["deltas"]]}
    gone = []
    for kind in ("delta", "base"):
        folder, fs = _folder(spark, f"{path}/{kind}")
        for top in fs.listStatus(folder) if fs.exists(folder) else []:
            name = f"{kind}/{top.getPath().getName()}"
            inner = [name] if kind == "delta" else [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(top.getPath()) if s.isDirectory()]
            used = [f for f in inner if f in named]
            for f in [name] if not used else [f for f in inner if f not in named]:
                fs.delete(_folder(spark, f"{path}/{f}")[0], True)
                gone.append(f)
    for v in known[:-keep]:
        file, fs = _folder(spark, f"{path}/manifest/{v:012d}.json")
        fs.delete(file, False)
    return gone
