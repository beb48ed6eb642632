"""Session helpers shared by the library: shipping the package and keeping intermediate tables."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_PACKAGE = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


#: Bytes of an Arrow batch at most, as kernels hold a few copies of it; a session's smaller bound stays.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, and keep their batches small."""
    found = re.fullmatch(r"(\d+)([kmg]?)b?", str(spark.conf.get(BATCH)).lower())
    if found and int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{_PACKAGE}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.join(_ROOT, _PACKAGE)):
            for name in names:
                if not name.endswith((".pyc", ".pyo")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one set here.

    Without the setting a local master gets a temporary folder and a cluster gets a folder in the
    warehouse, which executors can reach; the setting is stored for later calls.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        made = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    else:
        made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, name: str, tasks: int = 0, compression: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, cutting its lineage.

    The table survives the loss of executors and is deleted by discard(), or when the application's JVM
    ends. tasks, if given, keeps a table that is small for its input from being spread over more files
    than that; compression, if given, is Parquet's codec in place of the session's.
    """
    if tasks:
        df = df.coalesce(tasks)
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    drop_at_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() has written and nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            drop_path(t.sparkSession, path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop_at_exit(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.deleteOnExit(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this application has written."""
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)


def release_shuffles(spark: SparkSession, times: int = 1) -> None:
    """Let Spark delete shuffle files of finished jobs now: it does so once their plans are garbage."""
    for _ in range(times):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5 if times == 1 else 1.2)  # Spark's cleaner works beside
