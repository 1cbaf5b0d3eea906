"""Operator 7: near-duplicate documents by HyperMinHash, banding and exact checks.

1. One pass makes each document's set of 5-word shingle hashes and from it a 128-bit name of
   the set and a HyperMinHash signature.  Documents of equal sets form a class; only the
   smallest id of a class goes on, so copies never meet each other in a band.
2. The compressed registers are banded: ``BANDS`` keys of ``ROWS`` registers.  At the limit
   of 0.85 a pair shares no key with probability (1 - 0.85^6)^32, about 3e-7.
3. ``linking`` pairs the members of a bucket with its head and then only those members that
   may still be linked with each other; no bucket is squared and no link is lost.  Pairs
   whose collision-corrected estimate is six deviations under the limit go; the others are
   confirmed on their full sets, and links give components.

A document without words has an empty set and is linked with nothing; a document of fewer
than five words has the whole sequence as its one shingle.  Rows with a null ``doc_id`` are
linked with nothing and get a null component.  Rows that share an id are one node: each
keeps its own ``n_shingles``.  Ties do not arise: the smallest id stands for its component.
Very long texts are sketched whole, one at a time.  An empty table gives no rows.  Other
columns are not read; ``drop_near_duplicates`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from .columns import small_batches, texts
from .linking import link
from .membership import pick
from .minhash import BUCKETS, band_keys, estimate, signatures
from .scratch import cut
from .words import WORD_BYTES, mix, pieces, shingle_sets, string_bytes

BANDS, ROWS = 32, 6
LIMIT = 85
_SKETCH = "doc_id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>, registers binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", WORD_BYTES):
        sets = list(shingle_sets(*string_bytes(batch.column("text"))))
        size = np.array([len(s) for s in sets], np.int64)
        some = [s for s in sets if len(s)]
        keys, regs = np.empty((0, BANDS), np.int64), np.empty((0, BUCKETS), np.uint16)
        if some:
            regs = signatures(some)
            keys = band_keys(regs, BANDS, ROWS)
        names = np.zeros((len(sets), 2), np.int64)
        names[size > 0] = [[int(mix(s * np.uint64(m)).sum(dtype=np.uint64).view(np.int64)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)] for s in some] or np.empty((0, 2), np.int64)
        lists = iter(keys.tolist())
        raw = iter([r.tobytes() for r in regs])
        full = (size > 0).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(size), pa.array(names[:, 0]), pa.array(names[:, 1]),
                pa.array([next(lists) if f else None for f in full], pa.list_(pa.int64())), pa.array([next(raw) if f else None for f in full], pa.binary()),
            ],
            ["doc_id", "n", "s1", "s2", "bands", "registers"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", WORD_BYTES):
        sets = [s.view(np.int64) for s in shingle_sets(*string_bytes(batch.column("text")))]
        at = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["node", "shingles"])


@arrow_udf(DoubleType())
def _likeness(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    table = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, BUCKETS)
    parts = []
    for at in range(0, len(a), 2048):
        cut_ = [x.slice(at, 2048) for x in (a, b, n_a, n_b)]
        parts.append(estimate(table(cut_[0]), table(cut_[1]), np.asarray(cut_[2]), np.asarray(cut_[3])))
    return pa.array(np.concatenate(parts) if parts else np.empty(0))


def _likely(pairs: DataFrame, sketch: DataFrame, limit: int) -> DataFrame:
    """Pairs that sizes and the estimate, less six of its deviations, leave possible."""
    half = lambda x: sketch.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    near = pairs.join(half("a"), "a").join(half("b"), "b")
    near = near.where(100 * F.least("n_a", "n_b") >= limit * F.greatest("n_a", "n_b"))
    part = limit / 100
    spread = F.sqrt(F.lit(part * (1 - part)) / F.least(F.lit(BUCKETS), F.greatest("n_a", "n_b")))
    return near.where(_likeness("r_a", "r_b", "n_a", "n_b") >= F.lit(part) - 6 * spread).select("a", "b")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row."""
    small_batches(docs.sparkSession)
    rows = texts(docs)
    sketch = cut(rows.mapInArrow(_sketch, _SKETCH), "near-sketch")
    classes = cut(sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = sketch.where("n > 0").join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n"), ["doc_id", "s1", "s2", "n"], "left_semi")
    repeats = not sketch.groupBy("doc_id").count().where("count > 1").isEmpty()
    own = cut(reps.dropDuplicates(["doc_id", "s1", "s2", "n"]) if repeats else reps, "near-reps")
    bands = own.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        found = pick(rows, nodes.select(F.col("node").alias("doc_id")))
        return found.mapInArrow(_full_sets, "node bigint, shingles array<bigint>").distinct() if repeats else found.mapInArrow(_full_sets, "node bigint, shingles array<bigint>")

    labels = link(bands, sets_of, limit, lambda pairs: _likely(pairs, own, limit), "near")
    named = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    named = cut(named, "near-named")
    found = sketch.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    out = found.select("doc_id", F.col("n").alias("n_shingles"), component.cast("bigint").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` without the rows of documents that are not the smallest of their component."""
    gone = cut(near_duplicates(docs, limit).where("NOT kept").select("doc_id").distinct(), "near-gone")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["doc_id"], "left_anti")
