"""Hands this package to the Python workers of a session."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def ship_code(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Let workers import this package wherever they run; once for each application. Spark itself copies the archive to them."""
    # Batches bounded in bytes keep workers small where texts are long.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, source.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
