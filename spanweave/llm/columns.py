"""Reading documents and keeping callers' extra columns apart from an operator's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on Spark sends rows to Python workers in batches of ``BATCH_BYTES``, or of one row; a smaller bound of the session stays.

    Its own bound is 10,000 rows: 20 MB of texts of 2 kB, which the executor holds outside its heap and the worker once more.
    """
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as bigint, ``text`` as string, and columns named; others are not read."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def sha256(col) -> "F.Column":
    """Lowercase hex digest of a string's UTF-8 bytes or of a binary column."""
    return F.sha2(col, 256)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any letter case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name
