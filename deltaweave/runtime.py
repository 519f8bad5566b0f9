"""Session-level helpers shared by every operator: shared storage and code shipping.

Intermediate results that a plan reads more than once are written as Parquet to the folder that
``spark.checkpoint.dir`` names.  That folder is visible to the driver and to all executors, so a
lost executor never loses an intermediate result and lineage is cut at a durable table.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Folders of staged tables by application, until they are released.
_staged: dict[str, list[str]] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between two calls that give back the driver's unused memory, and when the last one was.
TIDY_SECONDS = 5
_tidied = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a session in plain local mode may have none: there a temporary folder is made and set.
    On a cluster a missing setting raises, since a driver-local folder would not be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="deltaweave-")
    spark.conf.set("spark.checkpoint.dir", base)
    sc.setCheckpointDir(base)
    _delete_on_exit(spark, base)
    return base


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back.

    The written table replaces the lineage of ``df``; it is deleted by ``release`` or when the driver ends.
    Nothing reads the shuffles behind it again, so their files and the driver's lists of them go at once.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/deltaweave/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    _delete_on_exit(spark, folder)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(folder)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(f"{folder}/{name}")
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def tidy(spark: SparkSession) -> None:
    """Give back memory that the driver's JVM holds but no longer uses, every ``TIDY_SECONDS`` at most.

    A heap that has grown beyond half its limit is collected, which shrinks it to a small multiple of
    what lives; what the compiler and ended threads freed goes back to the system, if this JVM can do that.
    """
    global _tidied
    if time.monotonic() - _tidied < TIDY_SECONDS:
        return
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.java.lang.System.gc()
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        beans.invoke(jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)
    except Py4JError:  # an older JVM, or no glibc
        pass
    _tidied = time.monotonic()


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this application: call it when every result that reads them has been used."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in _staged.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="deltaweave-code-")  # Spark serves the file from here while the driver runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "deltaweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("deltaweave", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
