"""What Python workers are sent, and how many of them a task needs."""

import pyarrow as pa

from spanweave.llm import byte_bpe
from spanweave.llm.membership import pick
from spanweave.llm.queries import bpe_pattern, tokenizer_file

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    before = spark.conf.get(BATCH, None)
    try:
        docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 200) AS text")
        byte_bpe.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), bpe_pattern())
        got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 6000 and max(r["bytes"] for r in got) < 5 << 20
        spark.conf.set(BATCH, "1m")
        byte_bpe.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), bpe_pattern())
        assert spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def test_picking_needs_no_python_worker(spark):
    docs = spark.range(0, 3000).selectExpr("IF(id = 7, NULL, id) AS doc_id", "CAST(id AS string) AS text", "'x' AS bloom")
    docs = docs.union(docs.where("doc_id IN (0, 70)"))
    for step in (7, 1, 5000):
        wanted = spark.range(0, 6000, step).selectExpr("id AS doc_id")
        got = pick(docs, wanted)
        ids = [r.doc_id for r in got.collect()]
        assert sorted(ids) == sorted([i for i in range(0, 3000, step) if i != 7] + [i for i in (0, 70) if i % step == 0])
        assert got.columns == ["doc_id", "text", "bloom"] and "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert pick(docs, spark.range(0).selectExpr("id AS doc_id")).isEmpty()
