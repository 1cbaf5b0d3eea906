"""Operator 1: passages of at least 50 words that repeat across documents.

Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.  Texts are read once to sketch
them (``_sketch``), and those that hold something shared once more to verify it.

1. Copies.  Documents of equal word sequences (128-bit names) form a class; all but the
   smallest ``doc_id`` of it go as a whole.
2. Paragraphs (lines of ``MIN_WORDS`` words or more) get MinHash bands over their 5-word
   shingles: ``BANDS`` bands of ``ROWS`` minima, so a pair at the limit of 0.8 meets with
   probability 1 - (1 - 0.8^3)^12 > 0.9998.  Paragraphs of equal shingles are one class;
   ``linking`` pairs what shares a bucket and confirms by exact Jaccard on the full sets, and
   links give components.  The paragraphs of a component go except those of its smallest document.
3. Passages.  One may be glued into the middle of paragraphs that are not alike, so words are
   also cut by content: in every ``SPREAD`` places in a row the one of the smallest hash is an
   anchor, and the ``BLOCK`` words from there are a sub-paragraph.  Any 50 words in a row hold a
   whole one.  Sub-paragraphs so short are similar by 0.8 only if all their inner words are
   equal, so their one band is the hash of all words.  Where two texts share one, every
   run of 50 words around it is compared as a whole (96-bit hashes of the 64-bit word hashes:
   edit distance 0), and equal runs are one component.  A run goes from every document but the
   smallest that holds it.  No partner is chosen beforehand, so a short copy elsewhere hides
   nothing, and no word goes that is not in a repeat.

Result rows are removals: ``doc_id``, ``start_word``, ``end_word`` (exclusive), ``keep_doc_id``
and ``kind`` (``copy``, ``paragraph`` or ``passage``).  Each 50 words in a row of a passage stand
in the kept document.  Rows of one document may overlap; ``spans`` merges them and ``remove``
takes them out of the texts.

Null, empty and short texts give no rows.  Rows with a null ``doc_id`` are not looked at.
Rows that share a ``doc_id`` are one document and never remove each other; removals of its
texts are listed together, those of identical rows once.  Ties do not arise: the smallest id keeps its words.  An empty
table gives no rows.  Other columns are not read.  A very long text is one row of arrays, 12 bytes
for each 17 of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import texts
from .linking import link
from .membership import pick
from .scratch import cut, discard
from .words import SHINGLE, mix, pieces, powers, shingle_hashes, string_bytes, word_hashes

MIN_WORDS = 50
BLOCK = 16
SPREAD = MIN_WORDS - BLOCK
BANDS, ROWS = 12, 3
LIMIT = 80
_RNG = np.random.default_rng(5)
_BLOCK_MULT = _RNG.integers(1, 2**63, BLOCK, dtype=np.uint64) | np.uint64(1)
_MIN_MULT = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_MULT = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_RUN_MULT = _RNG.integers(1, 2**63, (2, MIN_WORDS), dtype=np.uint64) | np.uint64(1)
_PARAGRAPH = "first:int,words:int,name:bigint,bands:array<bigint>"
_UNITS = f"doc_id bigint, s1 bigint, s2 bigint, words bigint, h array<bigint>, at array<int>, paragraphs array<struct<{_PARAGRAPH}>>"


def _weighted(words: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """A hash of the ``len(mult)`` words from each place; shorter by one less than ``words``."""
    n = len(words) - len(mult) + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i, m in enumerate(mult if n > 0 else ()):
        total += words[i : i + n] * m
    return mix(total)


def _anchors(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First words of the sub-paragraphs: pairs of words whose hash is the smallest of some ``SPREAD`` in a row of one text, the rightmost of equals."""
    h = mix(words[:-1] + words[1:] * np.uint64(0x9E3779B97F4A7C15))
    n = len(h) - SPREAD + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(len(h))
    width = 1
    while width < SPREAD:
        step = min(width, SPREAD - width)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        width += step
    end = np.repeat(at[1:], np.diff(at))
    chosen = np.zeros(len(words), bool)
    chosen[best[:n][np.arange(n) + SPREAD < end[:n]]] = True
    place = np.flatnonzero(chosen)
    return place[place + BLOCK <= end[place]]


def _names(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the whole word sequence of each text."""
    size = np.diff(at)
    power = powers(int(size.max(initial=0)))[np.arange(len(words)) - np.repeat(at[:-1], size)]
    total = lambda x: np.diff(np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)][at])
    return [mix(total(x * power)).view(np.int64) for x in (words, mix(words + np.uint64(1)))]


def _paragraphs(data: np.ndarray, words: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and number of words of each line of ``MIN_WORDS`` words or more."""
    lines = np.unique(np.r_[at, np.searchsorted(starts, np.flatnonzero(data == 10))])
    size = np.diff(lines)
    long = np.flatnonzero(size >= MIN_WORDS)
    first = lines[long]
    return np.searchsorted(at, first, "right") - 1, first, size[long]


def _list(values: pa.Array, row: np.ndarray, rows: int) -> pa.ListArray:
    """A list for each of ``rows`` rows; ``row`` is in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name, sub-paragraphs and banded paragraphs of each text of ``MIN_WORDS`` words or more."""
    for batch in pieces(batches, "text"):
        data, off = string_bytes(batch.column("text"))
        words, starts, _, at = word_hashes(data, off)
        size = np.diff(at)
        if not (size >= MIN_WORDS).any():
            continue
        rows, names = batch.num_rows, _names(words, at)
        place = _anchors(words, at)
        row = np.searchsorted(at, place, "right") - 1
        blocks = _weighted(words, _BLOCK_MULT)[place].view(np.int64)

        of, first, n = _paragraphs(data, words, starts, at)
        ends = np.c_[first, first + n - SHINGLE + 1].ravel()
        grams = np.r_[shingle_hashes(words), np.uint64(0)]
        least = np.empty((len(first), BANDS * ROWS), np.uint64)
        name = np.empty(0, np.int64)
        if len(first):
            for i, m in enumerate(_MIN_MULT):
                least[:, i] = np.minimum.reduceat(grams * m, ends)[::2]
            name = np.add.reduceat(mix(grams + np.uint64(7)), ends)[::2].view(np.int64)
        keys = mix((least * _BAND_MULT).reshape(-1, BANDS, ROWS).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        parts = [pa.array((first - at[of]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(name), bands]
        paragraphs = _list(pa.StructArray.from_arrays(parts, ["first", "words", "name", "bands"]), of, rows)

        columns = [batch.column("doc_id"), *map(pa.array, names), pa.array(size.astype(np.int64)), _list(pa.array(blocks), row, rows), _list(pa.array((place - at[row]).astype(np.int32)), row, rows), paragraphs]
        made = pa.RecordBatch.from_arrays(columns, ["doc_id", "s1", "s2", "words", "h", "at", "paragraphs"])
        yield made.filter(pa.array(size >= MIN_WORDS))


def _runs_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all 50 words in a row that hold a sub-paragraph which begins at one of ``at``; texts whose names are in ``skip`` are passed over."""
    for batch in pieces(batches, "text"):
        words, _, _, at = word_hashes(*string_bytes(batch.column("text")))
        if batch.column("skip").null_count < batch.num_rows:
            names = _names(words, at)[0].tolist()
            batch = batch.filter(pa.array([n not in (s or ()) for n, s in zip(names, batch.column("skip").to_pylist(), strict=True)]))
            words, _, _, at = word_hashes(*string_bytes(batch.column("text")))
        if len(words) < MIN_WORDS:
            continue
        size, wanted = np.diff(at), batch.column("at")
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(wanted.offsets)))
        place = np.asarray(wanted.flatten()).astype(np.int64)
        low, high = np.maximum(place - SPREAD, 0), np.minimum(place, size[row] - MIN_WORDS)
        some = low <= high
        edge = np.zeros(len(words) + 1, np.int32)
        np.add.at(edge, (at[row] + low)[some], 1)
        np.add.at(edge, (at[row] + high)[some] + 1, -1)
        start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        of = np.searchsorted(at, start, "right") - 1
        w1, w2 = (_weighted(words, m)[start].view(np.int64) for m in _RUN_MULT)
        cols = [pa.array(w1), pa.array((w2 >> 32).astype(np.int32)), batch.column("doc_id").take(pa.array(of)), pa.array((start - at[of]).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, ["w1", "w2", "doc_id", "start"])


def copies(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that equal a smaller document's (``doc_id``, ``s1``, ``words``, ``keep_doc_id``), and the ``doc_id`` of documents that have no others."""
    named = units.select("doc_id", "s1", "s2", "words")
    least = named.groupBy("s1", "s2", "words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").drop("last")
    keep = F.when(F.col("least") < F.col("doc_id"), F.col("least"))
    held = cut(named.join(least, ["s1", "s2", "words"], "left").select("doc_id", "s1", "words", keep.alias("keep_doc_id")), "sub-named")
    whole = held.groupBy("doc_id").agg(F.bool_and(F.col("keep_doc_id").isNotNull()).alias("all")).where("all").select("doc_id")
    return cut(held.where("keep_doc_id IS NOT NULL").distinct(), "sub-copies"), cut(whole, "sub-whole")


def repeated_runs(docs: DataFrame, units: DataFrame, copied: DataFrame, whole: DataFrame) -> DataFrame:
    """Removals of runs of 50 words or more, glued together where they follow each other."""
    keys = units.select("s1", F.explode("h").alias("h")).groupBy("h").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x < y").select("h")
    shared = cut(keys, "sub-shared")
    rows = units.select("doc_id", F.inline(F.arrays_zip("h", "at"))).join(shared, "h").select("doc_id", "at")
    places = rows.join(whole, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("at").alias("at"))
    partly = copied.join(whole, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("s1").alias("skip"))
    places = cut(places.join(partly, "doc_id", "left"), "sub-places")
    discard(shared)
    runs = cut(pick(docs, places).select("doc_id", "text", "at", "skip").mapInArrow(_runs_around, "w1 bigint, w2 int, doc_id bigint, start int"), "sub-runs")
    discard(places)
    least = runs.groupBy("w1", "w2").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last")).where("keep < last").drop("last")
    gone = runs.join(cut(least, "sub-kept"), ["w1", "w2"]).where("doc_id <> keep")
    each = gone.groupBy("doc_id", F.col("keep").alias("keep_doc_id")).agg(F.sort_array(F.collect_set("start")).alias("s"))
    first = F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1) < x - 1))
    last = F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1) > x + 1, F.lit(True)))
    glued = each.select("doc_id", "keep_doc_id", F.inline(F.arrays_zip(first.alias("a"), last.alias("z"))))
    out = cut(glued.select("doc_id", F.col("a").cast("bigint").alias("start_word"), (F.col("z") + MIN_WORDS).cast("bigint").alias("end_word"), "keep_doc_id"), "sub-gone")
    discard(runs)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the paragraphs whose first words the rows' ``wanted`` lists."""
    for batch in pieces(batches, "text"):
        data, off = string_bytes(batch.column("text"))
        words, starts, _, at = word_hashes(data, off)
        grams = shingle_hashes(words)
        of, first, n = _paragraphs(data, words, starts, at)
        wanted = [set(x) for x in batch.column("wanted").to_pylist()]
        here = (first - at[of]).tolist()
        found = [k for k, (r, f) in enumerate(zip(of.tolist(), here, strict=True)) if f in wanted[r]]
        lists = [grams[first[k] : first[k] + n[k] - SHINGLE + 1] for k in found]
        names = np.array([mix(x + np.uint64(7)).sum(dtype=np.uint64) for x in lists], np.uint64).view(np.int64)
        sets = [np.unique(x).view(np.int64) for x in lists]
        ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        columns = [batch.column("doc_id").take(pa.array(of[found], pa.int64())), pa.array([here[k] for k in found], pa.int32()), pa.array(names), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "first", "name", "shingles"])


def repeated_paragraphs(docs: DataFrame, units: DataFrame, copied: DataFrame) -> DataFrame:
    """Removals of whole paragraphs, exact or near."""
    every = units.select("doc_id", "s1", F.inline("paragraphs")).withColumn("p", F.xxhash64("doc_id", "first", "name"))
    classes = cut(every.groupBy("name", "words").agg(F.min("p").alias("rep")), "par-classes")
    reps = cut(every.join(classes.select(F.col("rep").alias("p")), "p", "left_semi").select("p", "doc_id", "first", "bands").distinct(), "par-reps")
    bands = reps.select(F.explode("bands").alias("key"), F.col("p").alias("node"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        known = reps.join(nodes.select(F.col("node").alias("p")), "p", "left_semi")
        wanted = cut(known.groupBy("doc_id").agg(F.collect_set("first").alias("wanted")), "par-wanted")
        found = pick(docs, wanted).select("doc_id", "text", "wanted").mapInArrow(_sets, "doc_id bigint, first int, name bigint, shingles array<bigint>")
        return found.select(F.xxhash64("doc_id", "first", "name").alias("node"), "shingles").dropDuplicates(["node"])

    labels = link(bands, sets_of, LIMIT, name="par")
    discard(reps)
    kind = classes.join(labels.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select("name", "words", F.coalesce("component", "rep").alias("component"))
    kind = cut(kind, "par-named")
    discard(classes)
    placed = cut(every.select("doc_id", "s1", "first", "words", "name").join(kind, ["name", "words"]).select("doc_id", "s1", "first", "words", "component"), "par-placed")
    discard(kind)
    keep = placed.groupBy("component").agg(F.min("doc_id").alias("keep_doc_id"), F.max("doc_id").alias("last")).where("keep_doc_id < last").drop("last")
    gone = placed.join(cut(keep, "par-keep"), "component").where("doc_id <> keep_doc_id").join(copied.select("doc_id", "s1"), ["doc_id", "s1"], "left_anti")
    return gone.select("doc_id", F.col("first").cast("bigint").alias("start_word"), (F.col("first") + F.col("words")).cast("bigint").alias("end_word"), "keep_doc_id").distinct()


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``start_word``, ``end_word``, ``keep_doc_id`` and ``kind`` of each removal."""
    rows = texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    units = cut(rows.mapInArrow(_sketch, _UNITS), "sub-units")
    copied, whole = copies(units)
    equal = copied.select("doc_id", F.lit(0).cast("bigint").alias("start_word"), F.col("words").alias("end_word"), "keep_doc_id", F.lit("copy").alias("kind"))
    paragraphs = repeated_paragraphs(rows, units, copied).withColumn("kind", F.lit("paragraph"))
    runs = repeated_runs(rows, units, copied, whole).withColumn("kind", F.lit("passage"))
    return equal.distinct().unionByName(paragraphs).unionByName(runs)


def spans(removals: DataFrame) -> DataFrame:
    """Removals of each document merged where they touch: ``doc_id``, ``start_word``, ``end_word``."""
    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = removals.withColumn("new", F.coalesce(F.col("start_word") > reach, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("run")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            raw = text.encode()
            _, begin, end, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            kept, at = [], 0
            for g in sorted(gone, key=lambda g: g["start_word"]):
                if g["start_word"] < len(begin):
                    kept.append(raw[at : begin[g["start_word"]]])
                    at = int(end[min(g["end_word"], len(end)) - 1])
            out.append(b"".join([*kept, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def remove(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of all rows, without the removed words; white space around them stays."""
    rows = texts(docs)
    gone = cut(spans(removals).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("gone")), "sub-spans")
    changed = pick(rows.where("text IS NOT NULL"), gone).select("doc_id", "text", "gone").mapInArrow(_without, "doc_id bigint, text string")
    same = rows.join(gone.select("doc_id"), "doc_id", "left_anti").unionByName(rows.where("text IS NULL").join(gone.select("doc_id"), "doc_id", "left_semi"))
    return changed.unionByName(same)
