"""Picking documents by id without shuffling the texts of all the others.

A join of texts with a table of wanted ids shuffles every text unless the table is small enough
to broadcast, and then it does so from one size of the data to the next.  Here the ids go into a
Bloom filter of at most ``MAX_BITS`` bits (8 MiB), whatever their number; texts it rejects stay
where they are and the rest meets the ids in an exact join.  The filter is a row that is broadcast
and tested in generated code: a Python worker of its own beside that of the next step would
double the workers that an executor keeps.  Beyond some seven million ids the
filter lets more through, up to all of them; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free_name

MAX_BITS = 1 << 26
BITS_AN_ID = 10


def _hash(doc_id: Column) -> Column:
    return F.xxhash64(F.lit("member"), doc_id)


def bloom(ids: DataFrame, name: str) -> tuple[DataFrame, int]:
    """One row whose column ``name`` holds the filter of ``ids`` (one bigint column ``doc_id``) as 64-bit words; and the mask of its places."""
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(10, (ids.count() * BITS_AN_ID).bit_length()))
    mask = bits - 1
    places = F.array(_hash(F.col("doc_id")).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(_hash(F.col("doc_id")), 32).bitwiseAND(F.lit(mask)))
    set_ = ids.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[set_.column("w").to_numpy()] = set_.column("b").to_numpy().view(np.uint64)
    words = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table.view(np.int64)))
    return ids.sparkSession.createDataFrame(pa.table({name: words})), mask


def likely_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most of the rows whose ``doc_id`` is not in ``ids``; none that is goes."""
    name = free_name(docs, "bloom")
    held, mask = bloom(ids, name)
    h = _hash(F.col("doc_id"))
    bit = lambda p: F.call_function("shiftrightunsigned", F.get(name, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    low, high = h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(mask))
    return docs.join(F.broadcast(held), bit(low) & bit(high)).select(*(docs[c] for c in docs.columns))


def pick(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` joined with ``wanted`` (stored; one row for each ``doc_id``) on ``doc_id``."""
    return likely_in(docs, wanted.select("doc_id")).join(wanted, "doc_id")
