"""Session state over a stream gives what the batch form gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from spanweave.operators import segment
from spanweave.streaming import sessions


def test_query_diff(spark, tmp_path):
    rng, begin = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(f"s{rng.randrange(4)}", i, begin + dt.timedelta(seconds=10 * i), rng.choices("abcdef", k=rng.randrange(4))) for i in range(40)]
    kind = "session_id string, query_id long, ts timestamp, tokens array<string>"
    for k in range(0, 40, 10):
        spark.createDataFrame(rows[k : k + 10], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    run = sessions.query_diff(stream).writeStream.format("memory").queryName("diffs").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.session_id, r.query_id, tuple(r.new_words)) for r in spark.table("diffs").collect()}
    batch = spark.createDataFrame(rows, kind)
    order = batch.select("query_id", "session_id", F.col("query_id").alias("query_ord"))
    want = {(r.session_id, r.query_id, tuple(r.new_words)) for r in segment.query_diff(batch.select("query_id", "tokens"), order).collect()}
    assert got == want and any(w for *_, w in got)
