"""Operator 2 (DataFrame functions only): drop lines that occur in several documents.

Each text is split at newlines; a line's key is the line without ``[\\x20\\x09-\\x0D]`` at
its ends, A-Z lower-cased.  Keys of at least ``min_chars`` code points that occur in at
least ``min_docs`` documents lose their lines everywhere but in the smallest ``doc_id``.

Plan: keys travel as 128-bit hashes, never as text.  One aggregation gives the smallest and
the number of documents of a key, with partial sums on the map side, so a line that a third
of all documents hold is a few rows there.  Its result is stored, so the join back to the
lines has a plain exchange on either side and adaptive execution can split a hot key.
Positions to drop come back to each document as one array, and the text is put together
from slices between them, in time linear in its length.

Null or empty texts are one empty line.  A null ``doc_id`` counts as one document that comes
after all others.  Rows that share a ``doc_id`` count as one document: none loses a line to
another.  Identical rows give identical rows.  All columns of the input stay;
those named like an output (``n_lines``, ``n_dropped``, ``kept_text``) are replaced.  A very
long text is one row here and one row a line in between.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free_name
from .scratch import cut

MIN_CHARS = 10
MIN_DOCS = 2
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick way where all characters are ASCII."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_WHITE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Keyed lines (document, text hash, position, key hash) and the keys of ``min_docs`` documents with their smallest."""
    lines = (
        docs.select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("t"), F.posexplode(_lines(F.col("text"))).alias("p", "line"))
        .select("d", "t", "p", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("d", "t", "p", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    if min_docs == 2:
        found = lines.groupBy("h1", "h2").agg(F.min("d").alias("keep"), F.max("d").alias("last"), F.bool_or(F.col("d").isNull()).alias("unnamed")).where("keep <> last OR unnamed AND keep IS NOT NULL")
    else:
        each = lines.groupBy("h1", "h2", "d").agg(F.lit(1).alias("one"))
        found = each.groupBy("h1", "h2").agg(F.min("d").alias("keep"), F.count("one").alias("n")).where((F.col("n") >= min_docs) & F.col("keep").isNotNull())
    return lines, found.select("h1", "h2", "keep")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input's columns and ``n_lines``, ``n_dropped``, ``kept_text``."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    docs = docs.select(*own)
    d, t, d2, t2, gone, split = (free_name(docs, "line_" + x) for x in ("doc", "text", "doc2", "text2", "gone", "split"))
    lines, found = repeated_keys(docs, min_chars, min_docs)
    found = cut(found, "line-keys")
    dropped = lines.join(found, ["h1", "h2"]).where("d IS NULL OR d <> keep").groupBy("d", "t").agg(F.sort_array(F.collect_set("p")).alias(gone))
    dropped = dropped.select(F.col("d").alias(d2), F.col("t").alias(t2), gone)
    keyed = docs.withColumn(d, F.col("doc_id").cast("bigint")).withColumn(t, F.xxhash64("text"))
    joined = keyed.join(dropped, F.col(d).eqNullSafe(F.col(d2)) & F.col(t).eqNullSafe(F.col(t2)), "left")
    joined = joined.withColumn(split, _lines(F.col("text")))
    drop, lines_, n = F.col(gone), F.col(split), F.size(split)
    gap = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.try_element_at(drop, i))
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(drop)),
            lambda i: F.slice(lines_, gap(i) + 2, F.coalesce(F.try_element_at(drop, i + 1), n) - gap(i) - 1),
        )
    )
    return joined.select(
        *own,
        n.cast("bigint").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(drop.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
