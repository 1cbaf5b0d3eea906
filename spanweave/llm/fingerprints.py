"""Operator 9 (DataFrame functions only): winnowing fingerprints of documents.

A text's units are its runs of up to 16 letters, marks and digits, lower-cased, and each
other character that is not white space.  Every ``K`` units in a row are hashed; of each
``WINDOW`` hashes in a row the smallest is chosen, the rightmost of equals.  The chosen
values keep hash (38 bits) and position (25 bits) in one number, so the smallest number is
the smallest hash with the rightmost place.  Two texts that share ``K + WINDOW - 1`` units in
a row share a chosen hash.  Texts of fewer than ``K`` units have one hash of all of them; a
text without units has the empty fingerprint.

The likeness of two fingerprints is the Jaccard similarity of their hashes (1 if both are
empty).  Fingerprints are written as hexadecimal numbers joined by blanks.

``with_next`` finds the next document by ``doc_id`` without a global sort: splitters are quantiles
of a bounded sample of ids; the first record of each bucket goes to the one before it too, and
the first of all to the last, so a window inside the bucket sees every successor.  The text is
shuffled once.  Where ids repeat, rows are numbered and stored first, and splitters fall between
numbers too, so rows that share an id are spread like others; the numbers have to be stored, as
a later read of the input may be split in another way.

Null texts are empty, a null ``doc_id`` comes last (as the greatest id), equal ids follow each
other in the order of their numbers (the input's splits and rows), and a single row is its own
successor.  Places count modulo 2^25: of a text with more units, equal hashes exactly that far
apart are one, which changes no likeness.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let, texts
from .scratch import cut

K, WINDOW = 3, 8
ROWS_A_BUCKET = 1_000
MAX_BUCKETS, DRAWS_A_BUCKET = 65_536, 4
_STEP = 16
_PLACE_BITS = 25
_LAST = 2**63 - 1
_UNIT = r"[\p{L}\p{M}\p{N}]{1,16}|[^\s\p{L}\p{M}\p{N}]"


def chosen(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Sorted by place: array of numbers that hold hash and place."""
    units = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    top = (1 << _PLACE_BITS) - 1

    def number(h: Column, i: Column) -> Column:
        place = F.lit(top) - i.cast("bigint").bitwiseAND(F.lit(top))
        return F.shiftleft(F.shiftrightunsigned(h, _PLACE_BITS + 1), _PLACE_BITS).bitwiseOR(place)

    def grams(u: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(u) - k), lambda i: number(F.xxhash64(*(F.get(u, i + j) for j in range(k))), i))
        return F.when(F.size(u) >= k, many).when(F.size(u) > 0, F.array(number(F.xxhash64(u), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    def winnow(v: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(v) - (window - 1)), lambda i: F.array_min(F.slice(v, i, window)))
        return F.when(F.size(v) > window, F.array_distinct(many)).when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(v)

    return let(let(units, grams), winnow)


def hashes(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda v: F.shiftright(v, _PLACE_BITS)))


def places(values: Column) -> Column:
    """Positions, in units, of the chosen hashes."""
    top = (1 << _PLACE_BITS) - 1
    return F.transform(values, lambda v: (F.lit(top) - v.bitwiseAND(F.lit(top))).cast("int"))


def written(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.hex(v)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / F.greatest(all_, F.lit(1)))


def _numbers(values: list, kind: str) -> Column:
    """A constant array."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _bucket(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are not above (o, r): counted among every 4096th, then each time among the next finer ones in between."""
    below = lambda s: (s["o"] < F.col("o")) | ((s["o"] == F.col("o")) & (s["r"] <= F.col("r")))
    at, stride = F.lit(0), 1
    while stride * _STEP < len(splitters):
        stride *= _STEP
    while stride:
        held = _numbers([{"o": o, "r": r} for o, r in splitters[stride - 1 :: stride]], "struct<o:bigint,r:bigint>")
        at = let(at * _STEP, lambda a: a + F.size(F.filter(F.slice(held, a + 1, _STEP), below)))  # noqa: B023
        stride //= _STEP
    return at


def with_next(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> tuple[DataFrame, "Window"]:
    """Rows ``doc_id``, ``text``, ``next_text``, ``ghost`` and the window they lie in; ghosts are only successors."""
    rows = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_LAST)).alias("o"))
    if rows.groupBy("o").count().where("count > 1").isEmpty():
        rows = rows.withColumn("r", F.lit(0).cast("bigint"))
    else:
        rows = cut(rows.withColumn("r", F.monotonically_increasing_id()), "next-docs")
    count = rows.count()
    n = min(MAX_BUCKETS, count // rows_a_bucket)
    splitters: list[tuple[int, int]] = []
    if n > 1:
        chance = F.shiftrightunsigned(F.xxhash64("o", "r"), 11) / float(1 << 53)
        drawn = sorted(map(tuple, rows.select("o", "r").where(chance < n * DRAWS_A_BUCKET / count).collect()))
        splitters = sorted({drawn[len(drawn) * i // n] for i in range(1, n)}) if drawn else []
    rows = rows.withColumn("b", _bucket(splitters))
    firsts = sorted((x.b, x.f.o, x.f.r) for x in rows.groupBy("b").agg(F.min(F.struct("o", "r")).alias("f")).collect())
    first, before = [{"o": _LAST, "r": -1}] * (len(splitters) + 1), [-1] * (len(splitters) + 1)
    for k, (b, o, r) in enumerate(firsts):
        first[b], before[b] = {"o": o, "r": r}, firsts[k - 1][0]
    own_first = F.get(_numbers(first, "struct<o:bigint,r:bigint>"), F.col("b")) == F.struct("o", "r")
    kind = "array<struct<b:int,late:int,ghost:boolean>>"
    own = F.array(F.struct(F.col("b"), F.lit(0), F.lit(False))).cast(kind)
    late = (F.col("b") == (firsts[0][0] if firsts else 0)).cast("int")
    ghost = F.when(own_first, F.array(F.struct(F.get(_numbers(before, "int"), F.col("b")), late, F.lit(True))).cast(kind))
    dealt = rows.select("doc_id", "text", "o", "r", F.inline(F.concat(own, F.coalesce(ghost, F.array().cast(kind)))))
    w = Window.partitionBy("b").orderBy("late", "o", "r")
    return dealt.withColumn("next_text", F.lead("text").over(w)), w


def fingerprints(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """``doc_id``, ``text``, ``next_text``, ``edited``, and the chosen numbers of all three (``chosen``, ``next_chosen``, ``edited_chosen``)."""
    rows, w = with_next(docs, rows_a_bucket)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", "text", "next_text", "b", "late", "o", "r", "ghost", edited.alias("edited"), chosen(F.col("text")).alias("chosen"))
    rows = rows.withColumn("next_chosen", F.lead("chosen").over(w)).where("NOT ghost")
    return rows.select("doc_id", "text", "next_text", "edited", "chosen", chosen(F.col("edited")).alias("edited_chosen"), "next_chosen")
