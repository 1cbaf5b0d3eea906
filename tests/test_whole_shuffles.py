"""The combined queries deal out little more than items, orders and histories, and give the SQL's rows."""

import duckdb
import pytest

from spanweave.plans import oracles
from spanweave.plans import queries as linking
from spanweave.sources.stage import release

SF = "/root/testdata/sf0.001"


def stages(spark):
    """Rows written to shuffles, by stage; the oldest stages are forgotten as new ones come."""
    jvm = spark.sparkContext._jvm
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(jvm.double, 0)
    done = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
    return {done.apply(i).stageId(): done.apply(i).shuffleWriteRecords() for i in range(done.size())}


@pytest.mark.parametrize("name", ["combined_winners", "combined_f1"])
def test_rows_shuffled(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        release(spark)
        last = max(stages(spark), default=-1)
        got = linking.QUERIES[name](spark, SF).collect()
        made = sum(n for k, n in stages(spark).items() if k > last)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "benchmark", "pages", "supplier", "nation", "region", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(oracles.SQL[name]).fetchall())
    assert 0 < made < 30_000
