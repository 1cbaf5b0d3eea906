"""The classifier against a plain fold of the same rule, and held-out quality on the labelled documents."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import EDGE, frame

from spanweave.llm import toxicity
from spanweave.llm.words import string_bytes

SF = "/root/testdata/sf0.1"


def places(text):
    return sorted(set(toxicity.features(*string_bytes(pa.array([text or ""])))[0].tolist()))


def plain(order):
    """FTRL-proximal as published, one row and one coordinate at a time."""
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = {}, {}

    def weight(i):
        limit = 0 if i == 1 << toxicity.BITS else l1
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= limit else -(v - math.copysign(limit, v)) / ((b + math.sqrt(n.get(i, 0.0))) / a + l2)

    for _ in range(toxicity.EPOCHS):
        for text, label in order:
            at = [*places(text), 1 << toxicity.BITS]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - label
            for i, x in zip(at, w, strict=True):
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / a * x
                n[i] = old + g * g
    return lambda text: 1 / (1 + math.exp(-sum(map(weight, [*places(text), 1 << toxicity.BITS]))))


def test_same_as_plain_fold(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)) + ["Scum", "of", "it"] * (i % 5 == 0))) for i in range(250)]
    rows.append((300, "scum " * 10_000))
    labels = [(i, int(i % 5 == 0)) for i, _ in rows] + [(None, 1), (7, None), (8, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x"))
    best = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            best[i] = max(y, best.get(i, 0))
    taught = frame(spark, rows).where(F.octet_length("text") <= toxicity.MAX_TRAIN_BYTES).select("doc_id", "text", F.xxhash64(F.lit("order"), "doc_id").alias("o"))
    score = plain([(r.text, best[r.doc_id]) for r in sorted(taught.collect(), key=lambda r: (r.o, r.doc_id, r.text)) if r.doc_id in best])
    every = rows + EDGE
    got = toxicity.toxicity(frame(spark, every), marks).collect()
    want = sorted((i is None, i or 0, score(t)) for i, t in every)
    for (r_null, r_id, r_score), (null, i, s) in zip(sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in got), want, strict=True):
        assert (r_null, r_id) == (null, i) and abs(r_score - s) < 1e-9
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_features():
    words = "a B c.d".replace(".", " ").lower().split()
    assert len(places("a B c.d")) == len({*words, *zip(words, words[1:]), *((a, b, 2) for a, b in zip(words, words[2:]))})
    assert places("x y") == places("X, Y!") and places("") == places(None) == [] and places("a b") != places("b a")


def test_held_out_quality(spark):
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), marks).join(marks, "doc_id").where("held_out").collect()
    hits = [(r.predicted, r.toxic) for r in got]
    bad = [p for p, y in hits if y]
    assert len(hits) > 500 and np.mean([p == y for p, y in hits]) >= 0.96 and np.mean(bad) >= 0.7


def test_no_labels_and_no_documents(spark):
    marks = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark, EDGE), marks.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(frame(spark, []), marks).count() == 0 and toxicity.drop_toxic(frame(spark, []), marks).count() == 0


def test_text_of_several_pieces(spark):
    """One text of over a mebibyte scores as its words do, whatever the cuts."""
    rows = [(i, f"bad w{i}" if i % 2 else f"good w{i}") for i in range(200)]
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    long = "filler " * 200_000
    got = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, [*rows, (900, long + "bad"), (901, "bad " + long), (902, "good"), (903, long)]), marks).collect()}
    assert got[900] > 0.5 and got[901] > 0.5 and got[902] < 0.5 and abs(got[900] - got[901]) < 0.2
