"""Operator 4 (DataFrame functions only): benchmark decontamination by templates.

Text becomes a template: numbers, units after numbers and names (capitalised words, those that
begin a sentence too) are typed placeholders, the other words are lower-cased letter runs;
punctuation does not count.  Windows of five words are hashed in two readings, as template and
as the lower-cased words themselves, and joined with the benchmark's; so a question with other
numbers or names is met by the first, one in other letter case by the second.

Matches of an item in a document are grouped by diagonal (place in the document less place in
the item).  On a diagonal each number, name or unit of the item must stand for one value of the
document, the most frequent (the greatest of equals); windows with another value do not count.
A document is contaminated by an item if the words in matched windows, on whatever diagonals,
are at least 0.8 of the item's, so one changed word costs itself and not five windows.

The windows of the benchmark are counted; up to ``BROADCAST_WINDOWS`` (24 bytes each) they are
broadcast and the documents' windows are never shuffled.  Beyond it only (text, place, hash) of
each window is shuffled, and the texts with a match are joined once to read their words.
Both ways give the same rows.  A document's words are cut out once, whatever its matches.

Items of fewer than five words match nothing, and neither do null or empty texts.  Repeated
items or documents count once; a null id is a value of its own.  Very long texts give many
windows, one row each.  Empty tables give no rows.  Other columns are not read; ``decontaminate``
keeps them and drops all rows of a contaminated ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, texts
from .scratch import cut, discard

WINDOW = 5
SHARE_PERCENT = 80
BROADCAST_WINDOWS = 500_000
#: Units that may follow a number, in lower case.
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|s|ms|min|h|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|miles|mile|meters|meter|feet|foot|inches|inch|pounds|pound|dollars|dollar|euros|euro|cents|cent|percent|liters|liter|grams|gram|degrees|degree"
NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
WORD = r"[\p{L}\p{M}]+"
NAME = r"^\p{Lu}\p{Ll}+$"


def raw_words(text: Column) -> Column:
    """Words and numbers in their own letter case."""
    return F.regexp_extract_all(text, F.lit(f"{NUMBER}|{WORD}"), F.lit(0))


def _special(w: Column) -> Column:
    """Whether a raw word may be a slot: false for what begins with a-z, by its code point, and is no unit's name."""
    return F.when(F.ascii(w).between(97, 122), F.lower(w).isin(UNITS.split("|"))).otherwise(True)


def _kind(words: Column, w: Column, i: Column) -> Column:
    """Type of a special raw word; null for a unit's name that follows no number."""
    number = lambda x: x.rlike(r"^\p{N}")
    return F.when(number(w), "<num>").when(w.rlike(NAME), "<name>").when((i > 0) & number(F.coalesce(F.get(words, i - 1), F.lit(""))), "<unit>")


def template(words: Column) -> Column:
    """Template words of raw words."""
    return F.transform(words, lambda w, i: F.coalesce(F.when(_special(w), _kind(words, w, i)), F.lower(w)))


def _windows(hashes: Column) -> Column:
    """Of a value that is bound: it is read once for each place."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW))))


def with_windows(rows: DataFrame) -> DataFrame:
    """``rows`` with raw words ``r``, one for each window of them in each reading: its place ``p`` and hash ``h``.

    Each step is a column of its own, so no array is made twice; arrays hold plain numbers, and rows are made of them in generated code.
    """
    own = rows.columns
    slot = lambda w, i: let(_kind(F.col("r"), w, i), lambda k: F.when(k.isNull(), F.get("plain", i)).otherwise(F.xxhash64(k)))
    typed = F.transform("r", lambda w, i: F.when(_special(w), slot(w, i)).otherwise(F.get("plain", i)))
    hashed = rows.where(F.size("r") >= WINDOW).select(*own, F.transform("r", lambda w: F.xxhash64(F.lower(w))).alias("plain"))
    hashed = hashed.select(*own, "plain", typed.alias("typed")).select(*own, _windows(F.col("typed")).alias("t"), _windows(F.col("plain")).alias("w"))
    each = hashed.select(*own, F.posexplode(F.arrays_zip("t", "w")).alias("p", "x"))
    return each.select(*own, "p", F.explode(F.when(F.col("x.t") == F.col("x.w"), F.array("x.t")).otherwise(F.array("x.t", "x.w"))).alias("h"))


def _key(*parts: str) -> Column:
    """A hash that tells a null from every value."""
    return F.xxhash64(*(x for p in parts for x in (F.col(p).isNull(), F.col(p))))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item`` (a key), ``item_id``, ``ip`` (place), ``h``, ``n_words`` and the window's template words and raw words, lower-cased."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    items = items.select("item_id", _key("item_id", "text").alias("item"), raw_words(F.col("text")).alias("r"))
    items = with_windows(items.select("item", "item_id", "r"))
    part = lambda x: F.slice(x, F.col("p") + 1, WINDOW)
    lower = F.transform(part(F.col("r")), lambda w: F.lower(w))
    return items.select("item", "item_id", F.col("p").alias("ip"), "h", F.size("r").cast("bigint").alias("n_words"), part(template(F.col("r"))).alias("it"), lower.alias("ir"))


def _hits(docs: DataFrame, keys: DataFrame, few: bool) -> DataFrame:
    """Windows that the documents share with ``keys`` (``h``, ``item``, ``ip``): ``doc_id``, ``doc``, ``dp``, ``dr``, ``item``, ``ip``."""
    rows = texts(docs).where("text IS NOT NULL").select("doc_id", _key("doc_id", "text").alias("doc"), raw_words(F.col("text")).alias("r"))
    words = F.transform(F.slice(F.col("r"), F.col("p") + 1, WINDOW), lambda w: F.lower(w)).alias("dr")
    if few:
        return with_windows(rows).join(F.broadcast(keys), "h").select("doc_id", "doc", F.col("p").alias("dp"), words, "item", "ip")
    narrow = with_windows(rows).select("doc", "p", "h").join(keys.select("h").distinct(), "h", "left_semi")
    places = cut(narrow.groupBy("doc").agg(F.collect_set(F.struct("p", "h")).alias("w")), "bench-places")
    again = rows.join(places, "doc").select("doc_id", "doc", "r", F.inline("w"))
    return again.select("doc_id", "doc", F.col("p").alias("dp"), words, "h").join(keys, "h").drop("h")


def matches(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each contaminated document and item: ``doc_id``, ``item_id``, ``n_words`` of the item, ``n_matched`` of them."""
    items = cut(item_windows(benchmark), "bench-windows")
    keys = items.select("h", "item", "ip")
    named = items.select("item", "item_id", "n_words", "ip", "it", "ir").distinct()
    hits = _hits(docs, keys, keys.count() <= broadcast_windows).distinct().join(named, ["item", "ip"])
    line = F.xxhash64("doc", "item", F.col("dp") - F.col("ip"))
    typed = F.filter(F.zip_with(F.arrays_zip("it", "ir"), "dr", lambda i, d: F.struct(i["it"].alias("k"), i["ir"].alias("i"), d.alias("d"))), lambda s: s["k"].startswith("<"))
    hits = cut(hits.select("doc_id", "doc", "item", "item_id", "n_words", "ip", line.alias("line"), typed.alias("slots")), "bench-hits")
    slots = hits.select("line", "ip", F.inline("slots"))
    votes = slots.groupBy("line", "k", "i", "d").agg(F.count("*").alias("n")).groupBy("line", "k", "i").agg(F.max(F.struct("n", "d"))["d"].alias("value"))
    bad = slots.join(votes, ["line", "k", "i"]).where("d <> value").select("line", "ip").distinct()
    places = hits.join(bad, ["line", "ip"], "left_anti").select("doc_id", "doc", "item", "item_id", "n_words", F.explode(F.sequence(F.col("ip"), F.col("ip") + WINDOW - 1)).alias("place")).distinct()
    found = places.groupBy("doc_id", "doc", "item", "item_id", "n_words").agg(F.count("*").alias("n_matched"))
    found = found.where(100 * F.col("n_matched") >= SHARE_PERCENT * F.col("n_words")).groupBy("doc_id", "item_id", "n_words").agg(F.max("n_matched").alias("n_matched"))
    found = cut(found, "bench-found")
    for old in (items, hits):
        discard(old)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents."""
    gone = cut(matches(docs, benchmark).select("doc_id").distinct(), "bench-gone")
    return docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone["doc_id"]), "left_anti")
