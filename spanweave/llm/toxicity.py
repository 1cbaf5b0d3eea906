"""Operator 3: toxicity by FTRL-proximal logistic regression on hashed word features.

Features are presence of words, bigrams and skip-grams (a word and the next but one), hashed
into 2^20 places; words are runs of letters and digits, A-Z lower-cased.  Learning sees
``MAX_TRAIN`` labelled rows at most, those of the smallest hashes of their ids, in that
order, and of them the texts of up to ``MAX_TRAIN_BYTES``: the two bounds here, both parameters.
They meet in one task (200 MB of text at the very most) that keeps their features, some
2 bytes for each of text, and makes ``EPOCHS`` passes; per-coordinate rates and L1 leave a few
thousand weights, which are broadcast (2^20 at most).  Scoring is one pass over all whole
texts, of any length, without a shuffle.

Labels are learned only where crc32 of the id as text, modulo 5, is not 0.  Rows with a null
label or id teach nothing; of several labels of an id the larger counts.  Null and empty
texts have no features and score the bias alone.  Without any label scores are 0.5.  Rows that
share an id are scored by themselves and all teach.  An empty table gives no rows.  Other
columns are not read; ``drop_toxic`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from .columns import small_batches, texts
from .words import WORD_BYTES, mix, pieces, string_bytes, word_hashes

BITS = 20
MAX_TRAIN, MAX_TRAIN_BYTES = 12_000, 16 << 10
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
FOLDS = 5
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_SHIFT = np.uint64(64 - BITS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of all rows, repeats included, and the row of each."""
    words, _, _, at = word_hashes(data, offsets, letters=True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    place, of = [words >> _SHIFT], [row]
    for gap, x, y in ((1, _A, _B), (2, _C, _D)):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            place.append((mix(words[:-gap] * x + words[gap:] * y) >> _SHIFT)[same])
            of.append(row[gap:][same])
    return np.concatenate(place).astype(np.int64), np.concatenate(of)


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; the last place is the bias, free of L1."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        limit = np.full(len(z), L1)
        limit[-1] = 0.0
        return -np.sign(z) * np.maximum(np.abs(z) - limit, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.r_[places, 1 << BITS]
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in pieces(batches, "text", WORD_BYTES):
        place, row = features(*string_bytes(batch.column("text")))
        keys = np.unique((row << BITS) | place)
        cuts = np.searchsorted(keys, np.arange(batch.num_rows + 1) << BITS)
        mask = (1 << BITS) - 1
        rows += [((keys[a:b] & mask).astype(np.int32), y) for a, b, y in zip(cuts[:-1], cuts[1:], batch.column("label").to_pylist(), strict=True)]
    model = Ftrl()
    for _ in range(EPOCHS):
        for places, label in rows:
            model.learn(places, label)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w[at])], ["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the model, the places in order."""
    small_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    marks = marks.where("label IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit("order"), "doc_id")
    few = marks.groupBy("doc_id").agg(F.max("label").alias("label")).select("doc_id", "label", order.alias("o")).orderBy("o", "doc_id").limit(max_train)
    short = texts(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    sample = short.join(F.broadcast(few), "doc_id").select("o", "doc_id", "label", "text")
    got = sample.repartition(1).sortWithinPartitions("o", "doc_id", "text").mapInArrow(_train, "place bigint, weight double").collect()
    got.sort()
    return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64)


def scorer(spark, model: tuple[np.ndarray, np.ndarray]) -> Callable[[Column], Column]:
    """A function of a text column that gives scores from 0 to 1."""
    held = spark.sparkContext.broadcast(model)

    @arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        places, weights = held.value
        dense = np.zeros((1 << BITS) + 1)
        dense[places] = weights
        _, off = string_bytes(text)
        out, at = np.full(len(text), dense[-1]), 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(off, off[at] + WORD_BYTES, "right")) - 1)
            place, row = features(*string_bytes(text.slice(at, end - at)))
            live = dense[place] != 0
            keys = np.unique((row[live] << BITS) | place[live])
            np.add.at(out, at + (keys >> BITS), dense[keys & ((1 << BITS) - 1)])
            at = end
        return pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return lambda text: score(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row."""
    score = scorer(docs.sparkSession, train(docs, labels, max_train))
    scored = texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all of them where no label teaches anything."""
    model = train(docs, labels, max_train)
    return docs.where(scorer(docs.sparkSession, model)(F.col("text")) < 0.5) if len(model[0]) else docs
