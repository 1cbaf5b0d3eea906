"""Intermediate tables in the folder that driver and executors share.

``cut`` writes a frame once as Parquet and reads it back.  That ends its lineage, survives
lost executors (the files are in the shared folder, not on an executor) and gives both
sides of a later join a plain exchange, which adaptive execution can split when skewed.
Once the table is written nothing reads the shuffle files that led to it, so Spark is told
to delete them then; otherwise they stay on the executors' disks until the driver collects garbage.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_ROOTS: dict[str, str] = {}
_ENDING: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; a temporary one only in local mode when unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL_ROOTS.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spanweave-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the application's own; all of them go when the driver ends."""
    if spark.sparkContext.applicationId not in _ENDING:
        _ENDING.add(spark.sparkContext.applicationId)
        atexit.register(release, spark)
    return f"{shared_root(spark)}/spanweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that no later plan reads."""
    path = getattr(df, "_spanweave_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, once all results are stored."""
    if spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Py4JError, OSError):  # at the end of the driver the JVM may be gone
        delete(spark, f"{shared_root(spark)}/spanweave-{spark.sparkContext.applicationId}")
