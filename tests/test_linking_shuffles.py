"""Rows that the linking pipelines shuffle, all stages together, on the smallest tables."""

import pytest

from spanweave.plans import queries as linking
from spanweave.sources.stage import release
from test_cells import shuffled

SF = "/root/testdata/sf0.001"
#: At most so many rows.
MOST = {
    "voting_f1": 150_000,
    "cascade_f1": 55_000,
    "dynamic_f1": 120_000,
    "combined_winners": 200_000,
    "combined_f1": 250_000,
}


@pytest.mark.parametrize("name", MOST)
def test_rows_shuffled(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        release(spark)
        began = shuffled(spark)
        linking.QUERIES[name](spark, SF).collect()
        assert shuffled(spark) - began < MOST[name]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
