"""Fingerprints, edited texts and likeness against plain winnowing."""

import collections
import random
import struct

import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from test_operators import EDGE, frame

from spanweave.llm import fingerprints as P


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def units(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]{1,16}|[^\x20\t\n\x0b\f\r\p{L}\p{M}\p{N}]", text.lower())


def winnow(text):
    """(hash, place) of each chosen k-gram: the smallest hash of every window, the rightmost of equals."""
    u = [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) for x in units(text)]
    grams = [hash_longs(u[i : i + P.K]) for i in range(len(u) - P.K + 1)] if len(u) >= P.K else [hash_longs(u)] if u else []
    short = [(g & (1 << 64) - 1) >> 26 for g in grams]
    w = P.WINDOW if len(short) > P.WINDOW else len(short)
    best = [min(range(i, i + w), key=lambda j: (short[j], -j)) for i in range(len(short) - w + 1)] if short else []
    return [(short[j], j) for j in dict.fromkeys(best)]


def written(chosen):
    top = (1 << 25) - 1
    return " ".join(f"{(h << 25) | (top - p):X}" for h, p in chosen)


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, after):
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "a", "Éa", "x1", "ß", "Straße,", "of.", "non-stop", "日本語", "é", "w" * 40, "\U0001f600"])
    body = lambda: " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 9, 10, 11, 60, 300])))
    return [(3 * i, body()) for i in range(150)]


@pytest.mark.parametrize("bucket", [1_000, 7])
def test_against_plain_winnowing(spark, rows, bucket):
    rows = rows + [(i, t) for i, t in EDGE if i != 905]
    order = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        e = edited(t, after)
        want[i, t, e, written(winnow(t)), written(winnow(e)), round(likeness(winnow(t), winnow(e)), 12), round(likeness(winnow(t), winnow(after)), 12)] += 1
    a, b, c = (P.hashes(F.col(x)) for x in ("chosen", "edited_chosen", "next_chosen"))
    made = P.fingerprints(frame(spark, rows), rows_a_bucket=bucket)
    got = made.select("doc_id", "text", "edited", P.written(F.col("chosen")), P.written(F.col("edited_chosen")), F.round(P.likeness(a, b), 12), F.round(P.likeness(a, c), 12))
    assert collections.Counter(map(tuple, got.collect())) == want


def test_equal_ids(spark):
    """Each row is followed by another; equal ids stand together, and rows keep their count."""
    rng = random.Random(6)
    rows = [(None, rng.choice(["", "again and again", "x"])) for _ in range(300)] + [(5, f"t{i} " * 9) for i in range(200)] + [(i, f"other {i}") for i in range(10, 60)]
    got = P.fingerprints(frame(spark, rows).repartition(5), rows_a_bucket=20).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    after = collections.Counter(r.next_text for r in got)
    assert after == collections.Counter(t for _, t in rows)
    first = {r.next_text for r in got if r.text == "other 59"}
    assert len(first) == 1 and first <= {"", "again and again", "x"}
    assert all(r.edited == edited(r.text, r.next_text) for r in got)


def test_shared_runs_share_a_hash(spark, rows):
    run = " ".join(f"s{k}" for k in range(P.K + P.WINDOW - 1))
    got = P.fingerprints(frame(spark, [(1, "a b c " + run + " d"), (2, "q " + run + " r s t u"), (3, run)])).select(P.hashes(F.col("chosen")).alias("h")).collect()
    assert set(got[0].h) & set(got[1].h) & set(got[2].h)


def test_long_text_and_empty_table(spark):
    long = "one two. " * 150_000
    got = P.fingerprints(frame(spark, [(1, long), (2, "two")])).orderBy("doc_id").collect()
    assert [tuple(x) for x in winnow(long)] == [(v >> 25, (1 << 25) - 1 - (v & (1 << 25) - 1)) for v in got[0].chosen]
    assert got[0].edited == edited(long, "two") and got[1].edited == "tw" + long[:1]
    assert P.fingerprints(frame(spark, [])).count() == 0
