"""Query sessions from XML: queries and gold spans by the reader's rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T

SCHEMA = (
    "session array<struct<_id:string,query:array<struct<_starttime:string,text:string,"
    "annotation:array<struct<span:string,target:struct<_VALUE:string,`_wiki-id`:string>>>>>>>"
)


def read_sessions(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """``session_id``, ``session_ord``, ``query_ord``, ``text``, ``starttime`` and raw ``annotations``.

    ``ordered`` reads a document as one row, so ``session_ord`` is the place in it; otherwise sessions are read in
    parallel, whatever the size of the files, and ``session_ord`` only tells them apart.
    """
    read = spark.read.format("xml").option("ignoreSurroundingSpaces", "false")
    if ordered:
        s = read.option("rowTag", "webscope").schema(SCHEMA).load(path).select(F.posexplode("session").alias("session_ord", "s"))
    else:
        s = read.option("rowTag", "session").schema(SCHEMA.removeprefix("session array<struct<").removesuffix(">>").replace("_id:string,query:", "_id string, query ")).load(path)
        s = s.select(F.monotonically_increasing_id().alias("session_ord"), F.struct("_id", "query").alias("s"))
    q = s.select("session_ord", F.col("s._id").alias("session_id"), F.posexplode("s.query").alias("query_ord", "q"))
    clean = F.replace(T.unquote(F.col("q.text")), F.lit('"'), F.lit(""))
    return q.select("session_id", "session_ord", "query_ord", clean.alias("text"), F.col("q._starttime").alias("starttime"), F.col("q.annotation").alias("annotations"))


@arrow_udf(StructType([StructField("position", IntegerType()), StructField("word_count", IntegerType())]))
def _place(spans: pa.Array, texts: pa.Array) -> pa.Array:
    """The span is a pattern, the last match counts; its place is the number of separators before it.  Null where it does not fit."""
    out = []
    for span, text in zip(spans.to_pylist(), texts.to_pylist(), strict=True):
        try:
            found = re.match(r"\W*(.*)" + span, text, re.IGNORECASE)
        except (re.error, TypeError):
            found = None
        out.append(found and {"position": len(re.findall(r"\W+", found.group(1))), "word_count": len(span.split())})
    return pa.array(out, pa.struct([("position", pa.int32()), ("word_count", pa.int32())]))


def gold_spans(queries: DataFrame) -> DataFrame:
    """Gold mentions with a target; a query with a span that does not fit is dropped as a whole."""
    key = ["session_ord", "query_ord"]
    each = queries.select(*key, "text", F.posexplode("annotations").alias("gold_ord", "a")).where("a.target IS NOT NULL")
    span = F.replace(T.unquote(F.col("a.span")), F.lit('"'), F.lit(""))
    each = each.withColumn("substring", span).withColumn("at", _place(F.col("substring"), F.col("text")))
    bad = each.where("at IS NULL").select(*key).distinct()
    good = each.join(bad, key, "left_anti")
    return good.select(*key, "gold_ord", "at.position", "at.word_count", "substring", T.entity_name(F.col("a.target._VALUE")).alias("link"))


def read_dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no``, ``surface``, ``value`` of a tab-separated dictionary file, in file order."""
    rows = spark.read.option("sep", "\t").schema("surface string, value string").csv(path)
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """``title`` of a file with one title a line; a first column of tab-separated ones."""
    return spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("title")).where("title <> ''")


def read_properties(spark: SparkSession, path: str, described: DataFrame) -> DataFrame:
    """``pid``, ``break_word``, ``ord`` of the property ids in a file, one a line: label and aliases of ``described`` (``pid``, ``label``, ``aliases``), lower-cased.

    ``ord`` follows the ids' numbers, then the place of the word: label first.
    """
    ids = spark.read.text(path).select(F.trim("value").alias("pid")).where("pid <> ''").distinct()
    words = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = ids.join(described, "pid").select("pid", F.posexplode(words).alias("place", "word")).where("word IS NOT NULL")
    place = (F.regexp_extract("pid", "[0-9]+", 0).cast("int") * 1_000 + F.col("place")).cast("int")
    return each.select("pid", F.lower("word").alias("break_word"), place.alias("ord"))
