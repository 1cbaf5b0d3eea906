"""Full-text queries over copies and common words: the rows of SQL, and no shuffle that grows with the pairs."""

import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.operators.cells import cells, six
from spanweave.plans import oracles
from spanweave.plans import queries as linking

N = 150


def shuffled(spark):
    """Rows that all stages so far have written for shuffles."""
    jvm = spark.sparkContext._jvm
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Titles of the same first words, some equal, with repeated words and ties."""
    at = str(tmp_path_factory.mktemp("alike"))
    title = [f"the old town of the {('hills', 'rivers', 'woods')[i % 3]} number {i // 2} zone" for i in range(N)]
    rows = [(i, f"<html><title>{t}</title><h1>{t if i % 4 else 'nothing'}</h1><p>old town text {i % 9} of the number {i}</p></html>") for i, t in enumerate(title)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(at + "/pages.parquet")
    return at


def same_as_sql(spark, at, name, most):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{at}/pages.parquet/*.parquet')")
    want = con.execute(oracles.SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    before = shuffled(spark)
    got = linking.QUERIES[name](spark, at).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert shuffled(spark) - before < most


def test_ft_and(spark, alike):
    same_as_sql(spark, alike, "ft_and", 20 * N)


def test_ft_or(spark, alike):
    same_as_sql(spark, alike, "ft_or", 20 * N)


def test_six_places_as_spark_rounds(spark):
    x = [0.1234565, 0.0000005, 0.3333335, 1.0000005, 0.2499995, 1 / 3, 2 / 3]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert six(np.array(x)).tolist() == want


def test_ft_or_best(spark, alike):
    same_as_sql(spark, alike, "ft_or_best", 20 * N)


def test_cells_in_many_blocks(spark):
    """Small blocks give what one block gives; keys and musts hold."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.split(F.concat_ws(" ", F.lit("w"), F.concat(F.lit("a"), F.col("id") % 7), F.concat(F.lit("b"), F.col("id") % 5)), " ").alias("words"), (F.col("id") % 3).cast("string").alias("key"))
    asked = docs.withColumnRenamed("doc_id", "query_id").withColumn("must", F.slice("words", 2, 1))
    for keep in ("any", "every", 0.9, 1):
        got = [sorted(map(tuple, cells(asked, docs, keep, d, q).collect())) for d, q in ((7, 5), (1000, 1000))]
        assert got[0] == got[1] and got[0]
        assert all(q % 3 == d % 3 and q % 7 == d % 7 for q, d, _ in got[0])


@pytest.mark.parametrize("keep", ["any", "every", 1])
def test_blocks_are_dealt_once(spark, keep):
    """Without keys, twenty blocks of either kind shuffle each row a few times, not once for each block of the other kind."""
    words = F.split(F.concat_ws(" ", F.lit("w"), F.concat(F.lit("a"), F.col("id") % 7), F.concat(F.lit("b"), F.col("id"))), " ")
    docs = spark.range(600).select(F.col("id").alias("doc_id"), words.alias("words"))
    asked = docs.withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, cells(asked, docs, keep).collect()))
    before = shuffled(spark)
    got = cells(asked, docs, keep, 30, 30)
    assert sorted(map(tuple, got.collect())) == want and len(want) == (600 if keep != "any" else 600 * 600)
    assert shuffled(spark) - before < (20_000 if keep == 1 else 6 * 600)
    assert keep == 1 or got.rdd.getNumPartitions() == 400


@pytest.mark.parametrize("keep", ["any", 1])
def test_nothing_to_ask_or_to_find(spark, keep):
    some = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, words array<string>")
    for q, d in ((some, some.where("id = 2")), (some.where("id = 2"), some), (some.where("id = 3"), some.where("id = 3"))):
        assert cells(q.withColumnRenamed("id", "query_id"), d.withColumnRenamed("id", "doc_id"), keep).collect() == []


def test_title_rescore(spark, alike):
    same_as_sql(spark, alike, "title_rescore", 20 * N)


def test_title_greedy(spark, alike):
    same_as_sql(spark, alike, "title_greedy", 60 * N)


def test_title_project(spark, alike):
    same_as_sql(spark, alike, "title_project", 60 * N)


def test_disambiguation(spark, alike):
    same_as_sql(spark, alike, "disambiguation", 20 * N)


def test_title_cascade(spark, alike):
    for t in ("supplier", "nation", "region"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", alike)
    same_as_sql(spark, alike, "title_cascade", 100 * N)
