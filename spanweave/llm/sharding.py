"""Operator 6: shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, hash of id and row), so equal texts are neighbours.
Keys are sampled with a probability in proportion to their size; weighted quantiles of the
sample cut the order into ranges, always at the first record of a text.  Ranges that turn out
over twice the mean are sampled again and subdivided: between texts where they hold several,
else inside the one text.  So every record is placed by sampled splitters, whatever its size,
and no task holds more than a range: a text of many copies is spread over many tasks.

Ranges are dealt to shards by their exact bytes, the largest first to the emptiest.  The
ranges of one text go together while the text is no larger than a shard; a larger one is cut
into as few parts as fit.  With ``RANGES_A_SHARD`` ranges to a shard the sizes differ by less
than a range, unless single records or texts are larger than that and too few to be evened out.

Sizes are UTF-8 bytes plus 16; a null text counts as empty.  Repeated rows are records of
their own, and a null ``doc_id`` is an id like others.  Which of equal texts takes which slot
follows the input's splits, and so does the sample.  An empty table gives no rows.  Other
columns are not read.  Texts of any length are one number here; they are read once.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

from .columns import texts
from .scratch import cut, discard

SHARDS = 40
RECORD_BYTES = 16
RANGES_A_SHARD = 64
ROWS_A_RANGE = 100_000
#: Bounds what the driver holds: ranges, and as many draws for each of them.
MAX_RANGES, DRAWS_A_RANGE, ROUNDS = 20_000, 8, 6
_FIRST = -(2**63)


def records(docs: DataFrame) -> DataFrame:
    """One narrow row for each of ``docs``: ``h`` orders texts, ``t`` the rows of a text."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + RECORD_BYTES).cast("bigint")
    return texts(docs).select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("t"))


def _draw(rows: DataFrame, rate: float, salt: str) -> list[tuple[int, int, float]]:
    """Rows drawn with probability size * rate, of weight 1, or of that product where it is larger."""
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(salt), "h", "t"), 11) / float(1 << 53)).cast("double")
    expected = F.col("size") * F.lit(rate)
    got = rows.where(chance < expected).select("h", "t", F.greatest(expected, F.lit(1.0)).alias("w")).toArrow()
    return sorted(zip(*(got.column(c).to_pylist() for c in ("h", "t", "w")), strict=True))


def _between_texts(drawn: list[tuple[int, int, float]], weight: float) -> set[tuple[int, int]]:
    """Starts of texts after every ``weight``; a text of that weight has one on either side."""
    out, run = set(), 0.0
    for h, same in itertools.groupby(drawn, key=lambda x: x[0]):
        own = sum(x[2] for x in same)
        if run + own > weight:
            out.add((h, _FIRST))
            run = 0.0
        run += own
        if own >= weight and h + 1 < 2**63:
            out.add((h + 1, _FIRST))
            run = 0.0
    return out


def _inside_text(drawn: list[tuple[int, int, float]], weight: float) -> set[tuple[int, int]]:
    out, run = set(), 0.0
    for h, t, w in drawn:
        if run and run + w > weight:
            out.add((h, t))
            run = 0.0
        run += w
    return out


def _range_of(splitters: list[tuple[int, int]]):
    """Column: how many splitters are not above (h, t)."""
    hs, ts = (np.array([s[i] for s in splitters], np.int64) for i in (0, 1))

    @arrow_udf(IntegerType())
    def find(h: pa.Array, t: pa.Array) -> pa.Array:
        h, t = np.asarray(h), np.asarray(t)
        low, high = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
        out = low.copy()
        ties = np.flatnonzero(low < high)
        for a in np.unique(low[ties]).tolist():
            rows = ties[low[ties] == a]
            out[rows] = a + np.searchsorted(ts[a : high[rows[0]]], t[rows], "right")
        return pa.array(out.astype(np.int32))

    return find(F.col("h"), F.col("t"))


def ranges(every: DataFrame, total: int, count: int, shards: int) -> tuple[list[tuple[int, int]], list]:
    """Splitters, and of each range that has rows its number, bytes, rows and the texts at its ends."""
    wanted = min(MAX_RANGES, max(shards * RANGES_A_SHARD, math.ceil(count / ROWS_A_RANGE)))
    mean = max(1.0, total / wanted)
    splitters = sorted(_between_texts(_draw(every, DRAWS_A_RANGE / mean, "first"), DRAWS_A_RANGE))
    for k in itertools.count(1):
        found = every.groupBy(_range_of(splitters).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high")).collect()
        over = {r.range: r.low == r.high for r in found if r.bytes > 2 * mean and r.rows > 1}
        if not over or k == ROUNDS:
            return splitters, sorted(found)
        inside = every.where(_range_of(splitters).isin(list(over))).select("h", "t", "size")
        drawn = _draw(inside, 4 * DRAWS_A_RANGE / mean, f"again {k}")
        at = [bisect.bisect_right(splitters, (h, t)) for h, t, _ in drawn]
        more = set(splitters)
        for r, part in itertools.groupby(zip(at, drawn, strict=True), key=lambda x: x[0]):
            more |= (_inside_text if over[r] else _between_texts)([x[1] for x in part], 4 * DRAWS_A_RANGE)
        if len(more) == len(splitters):
            return splitters, sorted(found)
        splitters = sorted(more)


def deal(found: list, total: int, shards: int) -> dict[int, int]:
    """The shard of each range: parts of whole texts as large as a shard at most, the largest first to the emptiest shard."""
    parts: list[tuple[int, list[int]]] = []
    for _, same in itertools.groupby(found, key=lambda r: (r.low if r.low == r.high else None, r.range if r.low != r.high else None)):
        same = list(same)
        size = sum(r.bytes for r in same)
        n = max(1, math.ceil(size * shards / max(1, total)))
        held, run = [[] for _ in range(n)], 0
        for r in same:
            held[min(n - 1, (run + r.bytes // 2) * n // size)].append(r)
            run += r.bytes
        parts += [(sum(r.bytes for r in x), [r.range for r in x]) for x in held if x]
    room = [(0, s) for s in range(shards)]
    shard_of = {}
    for size, numbers in sorted(parts, key=lambda p: (-p[0], p[1])):
        used, s = heapq.heappop(room)
        heapq.heappush(room, (used + size, s))
        shard_of |= dict.fromkeys(numbers, s)
    return shard_of


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null under this law)."""
    spark = docs.sparkSession
    every = cut(records(docs), "shard-records")
    total, count = every.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    splitters, found = ranges(every, total, count, shards)
    shard_of = deal(found, total, shards)
    filled, starts = dict.fromkeys(range(shards), 0), []
    for r in found:
        s = shard_of[r.range]
        starts.append((r.range, s, filled[s]))
        filled[s] += r.rows
    held = spark.createDataFrame(starts, "range int, shard int, begin bigint")
    numbered = every.withColumn("range", _range_of(splitters)).withColumn("row", F.row_number().over(Window.partitionBy("range").orderBy("h", "t")))
    slot = F.col("begin") + F.col("row") - 1
    out = numbered.join(F.broadcast(held), "range").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    out = cut(out, "shard-slots")
    discard(every)
    return out
