"""Tables stored between the steps of a pipeline, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_ROOTS: dict[str, str] = {}
_HELD: dict[tuple[str, str, str], DataFrame] = {}
_ENDING: set[str] = set()
_TABLES: dict[str, list[str]] = {}
#: Stored tables of at most so many bytes are sent to all tasks.
SENT = 16 << 20


def root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    shared, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _LOCAL_ROOTS.get(app) or _LOCAL_ROOTS.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spanweave-"))
    return f"{shared.rstrip('/')}/spanweave-linking-{app}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from files, whatever made them; shuffle files that led there go at once.

    ``by`` deals the rows into buckets of that column, so later groups and joins by it shuffle nothing.
    """
    spark = df.sparkSession
    if spark.sparkContext.applicationId not in _ENDING:
        _ENDING.add(spark.sparkContext.applicationId)
        atexit.register(release, spark)
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        if by:
            n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"spanweave_{uuid.uuid4().hex}"
            _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
            df.repartition(n, by).write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(table)
        else:
            df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.table(table) if by else spark.read.schema(df.schema).parquet(path)
    out._spanweave_path = path
    return out


def _place(df: DataFrame):
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._spanweave_path)
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), path


def _stands(df: DataFrame) -> bool:
    files, path = _place(df)
    return files.exists(path)


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    files, path = _place(df)
    files.delete(path, True)


def sent(df: DataFrame) -> DataFrame:
    """A stored table, marked to be sent to all tasks if it is small."""
    files, path = _place(df)
    return F.broadcast(df) if files.getContentSummary(path).getLength() <= SENT else df


def once(make: Callable[[], DataFrame], spark: SparkSession, source: str, name: str, by: str | None = None) -> DataFrame:
    """``stage`` of what ``make`` builds from the tables in ``source``, built once in an application; again if its files are gone."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _HELD or not _stands(_HELD[key]):
        _HELD[key] = stage(make(), name, by)
    return _HELD[key]


def release(spark: SparkSession) -> None:
    """Delete this application's stored tables, once all results are stored; also at the end of the driver."""
    _HELD.clear()
    if spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Py4JError, OSError):  # at the end of the driver the JVM may be gone
        for table in _TABLES.pop(spark.sparkContext.applicationId, []):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
