"""Both branches, winners and ratings from whole queries in one row: as by joins, and almost nothing is shuffled."""

import random
from dataclasses import replace

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.operators import segment, whole
from spanweave.plans.pipelines import Linker
from spanweave.sources.stage import release

SF = "/root/testdata/sf0.001"
#: Orders without a session, of none and of a null customer, and two of one date.
ODD = {
    "plain": "SELECT * FROM o",
    "gone": "SELECT * FROM o WHERE o_orderkey % 7 <> 0",
    "one session": "SELECT * REPLACE (CAST(o_custkey % 2 AS BIGINT) AS o_custkey, TIMESTAMP '1996-01-01' AS o_orderdate) FROM o",
    "null session": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS o_orderdate) FROM o",
}


def by_joins(x):
    t, winners = x.combined()
    return sorted(map(tuple, winners.collect())), x.score(t).collect()


def by_rows(x):
    return sorted(map(tuple, x.combined_winners().select("query_id", "winner").collect())), x.combined_score().collect()


@pytest.mark.parametrize("kind", ODD)
def test_as_by_joins(spark, tmp_path, monkeypatch, kind):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"COPY (WITH o AS (SELECT * FROM '{SF}/orders.parquet') {ODD[kind]}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        x = Linker(spark, str(tmp_path))
        want = by_joins(x)
        assert x.combined_whole(False) is not None and by_rows(x) == want
        monkeypatch.setattr(whole, "DENSE", 0)
        assert by_rows(x) == want
        other = replace(x, compat=False, theta=0.2, epsilon=0.05)
        assert by_rows(other) == by_joins(other) != want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        release(spark)


def test_unfit_tables_go_by_joins(spark, tmp_path, monkeypatch):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{SF}/orders.parquet' UNION ALL SELECT * FROM '{SF}/orders.parquet' WHERE o_orderkey = 5) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    x = Linker(spark, str(tmp_path))
    assert x.combined_whole(False) is None and x.combined_winners().count() > 0
    monkeypatch.setattr(whole, "MOST", 10)
    assert Linker(spark, SF).combined_whole(True) is None
    release(spark)


@pytest.mark.parametrize("max_n", [None, 3, 1])
def test_mentions_of_long_surfaces(spark, max_n):
    """Surfaces of up to five words over few words, so that most n-grams cross; blanks at ends and in rows; priors that tie."""
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "b", "c", "dd", ""])
    surfaces = sorted({" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(300)})
    rows = [(s, r + 1, f"L{(i + r) % 9}", rng.choice([0.2, 0.5, 0.9])) for i, s in enumerate(surfaces) for r in range(1 + i % 3)]
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "", "zz"]) for _ in range(rng.randint(1, 14))) for _ in range(200)]
    dictionary = spark.createDataFrame(rows, "surface string, rank int, link string, prob double")
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string").select("query_id", F.split("text", " ").alias("tokens"))
    got = segment.resolve_overlaps(segment.lookup(segment.ngrams(queries, max_n), dictionary))
    want = [(r.query_id, r.surface, r.position, r.word_count, r.chosen) for r in got.orderBy("query_id", "ord").collect()]
    has = whole.known(dictionary, spark.createDataFrame([], "e1 string, e2 string, rel double"), spark.createDataFrame([("L1", "M")], "link string, canonical string"), 50, 0.005)
    b = whole._Batch(has, pa.RecordBatch.from_pydict({"tokens": [t.split(" ") for t in texts]}), max_n)
    names = has.surfaces.to_pylist()
    assert list(zip(b.q.tolist(), [names[s] for s in b.s], b.position.tolist(), b.words.tolist(), b.old.tolist(), strict=True)) == want and len(want) > 300
