"""Tables of queries stored in buckets: groups and joins by query shuffle nothing, and items come in the SQL's order."""

import duckdb
import pytest

from spanweave.operators import segment, voting
from spanweave.plans import oracles
from spanweave.plans.pipelines import Linker
from spanweave.sources import tables
from spanweave.sources.stage import release
from test_cells import shuffled

SF = "/root/testdata/sf0.001"


@pytest.fixture
def linker(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    release(spark)
    yield Linker(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cascade_shuffles_no_mentions(spark, linker):
    got = segment.resolve_overlaps(linker.cascaded)
    before, n = shuffled(spark), linker.queries.count()
    got.write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < n


def test_dynamic_program_shuffles_no_candidates(spark, linker):
    m, d, rel, s = linker.mentions, linker.dictionary, linker.rel, linker.sessions
    out = voting.dp_choice(m, d, rel, s)
    before = shuffled(spark)
    out.write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < linker.queries.count()


def test_items_of_equal_numbers_and_repeated_parts(spark, tmp_path):
    con, at = duckdb.connect(), str(tmp_path)
    line = "(0, 7, 2, 1, 9.0, 5.0), (0, 7, 1, 1, 3.0, 8.0), (0, 5, 9, 1, 2.0, 2.0), (0, 5, 1, 0, 1.0, 1.0), (1, 7, 1, 2, 1.0, 1.0), (1, 4, 1, 2, 1.0, 1.0), (2, 6, 1, 1, 1.0, 1.0)"
    for tag, part in (("once", "(4, 'd d', 'Brand#4'), (5, 'b b', 'Brand#5'), (7, 'a a', 'Brand#7')"), ("twice", "(4, 'd d', 'Brand#4'), (5, 'b b', 'Brand#5'), (5, 'b b', 'Brand#5'), (7, 'a a', 'Brand#7')")):
        sf = tmp_path / tag
        sf.mkdir()
        con.execute(f"CREATE OR REPLACE TABLE part AS SELECT * FROM (VALUES {part}) t(p_partkey, p_name, p_brand)")
        con.execute(f"CREATE OR REPLACE TABLE lineitem AS SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, TIMESTAMP '1996-01-01' AS l_shipdate FROM (VALUES {line}) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice)")
        for t in ("part", "lineitem"):
            con.execute(f"COPY {t} TO '{at}/{tag}/{t}.parquet' (FORMAT parquet)")
        want = con.execute(f"WITH items AS ({oracles._CTES['items']}) SELECT query_id, list(p_name ORDER BY i), list(p_brand ORDER BY i) FROM items GROUP BY query_id").fetchall()
        got = [(r.query_id, r.names, r.brands) for r in tables.items(spark, f"{at}/{tag}").collect()]
        assert sorted(got) == sorted(want) and len(want) == 2
