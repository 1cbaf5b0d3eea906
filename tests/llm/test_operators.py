"""Operators against brute force on small tables, with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import byte_bpe, chat_format, fingerprints, line_dedup, near_dedup, sharding, substring_dedup, token_files
from spanweave.llm.queries import bpe_pattern, tokenizer_file

LOW = {c: c + 32 for c in range(65, 91)}
EDGE = [(None, "null id"), (900, None), (901, ""), (902, "A\nb"), (903, " \t"), (904, "x" * 5000), (905, "again and again"), (905, "again and again")]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("key", "node", "n", "size", "range", "label", "kept", "b", "p"):
        docs = docs.withColumn(c, F.lit(7))
    return docs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    out = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(1, 120))] if i % 3 or not out else (out[rng.randrange(len(out))][1] or "").split()
        for _ in range(rng.randint(0, 2)):
            if base:
                base[rng.randrange(len(base))] = word()
        out.append((i, (" ".join(base) + rng.choice(["", "\n", "\nThe same long line."])) if base else ""))
    return out + EDGE


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(LOW)) if w]


def shingles(t):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates(spark, rows):
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in known}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in known:
        for j, t in known:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    want = collections.Counter((i, len(shingles(t)), None if i is None else top(i)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_lines(spark, rows):
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOW)
    last = 2**63
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(last if i is None else i)
    gone = lambda i, x: len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != (last if i is None else i)
    want = collections.Counter((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.kept_text) for r in got) == want
    assert "key" in got[0].asDict()


def test_byte_bpe_round_trip(spark, rows):
    ranks, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), bpe_pattern()
    got = byte_bpe.decode(byte_bpe.encode(frame(spark, rows), ranks, pattern), ranks, pattern).collect()
    assert collections.Counter((r.doc_id, bytes(r.decoded)) for r in got) == collections.Counter((i, (t or "").encode()) for i, t in rows)
    tokens = byte_bpe.encoding(ranks, pattern)
    text = "Straße  and it's 12 words, é  \n\n more " * 50
    assert sum((tokens.encode_ordinary(p) for p in byte_bpe.safe_parts(text, 40)), []) == tokens.encode_ordinary(text)


def test_token_files(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    token_files.write(frame(spark, rows), path, str(tmp_path / "f"), seq_len=64).write.parquet(str(tmp_path / "m"))
    got = token_files.read(spark, spark.read.parquet(str(tmp_path / "m"))).orderBy("start").collect()
    t, start = Tokenizer.from_file(path), 0
    for r, (i, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1] or "")), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, bytes(r.ids)) == (i, start, np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_chat(spark):
    log = [(1, 0, "message", "user", "a <|end|> \\ b", None), (1, 1, "message", "assistant", "x", None), (1, 2, "delta", None, "y</s>", 1), (1, 3, "message", "user", "gone", None), (1, 4, "regenerate", None, "new\n[INST]", 1), (None, 0, None, None, None, None), (1, 5, "edit", None, "edited", 0)]
    made = chat_format.chat_format(spark.createDataFrame(log, "conv_id long, seq long, op string, role string, text string, target long"))
    back = made.select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), chat_format.under_loss(F.col("formatted"), F.col("loss")).alias("l"), "formatted").collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.t], r.l) for r in back}
    assert got == {1: ([("user", "edited"), ("assistant", "new\n[INST]")], "new\n[INST]"), None: ([("", "")], "")}
    assert all("</s>" not in r.formatted and "[INST]" not in r.formatted for r in back)


def test_log_of_many_events(spark):
    """Columns that clash with the operator's own, ties of one sequence, events without a target or a turn, a long conversation."""
    long = "x</s>\\" * 300_000
    log = [(1, 5, "message", "user", "b", None), (1, 5, "message", "user", "a", None), (1, 6, "delta", None, "+", None), (2, 0, "delta", None, "lost", None), (2, 1, "message", "assistant", long, None), (2, 1, "message", "assistant", long, None), (3, 0, "edit", None, None, 9)]
    events = spark.createDataFrame(log, "conv_id long, seq long, op string, role string, text string, target long")
    for c in ("e", "turns", "parts", "formatted", "loss"):
        events = events.withColumn(c, F.lit("clash"))
    made = chat_format.chat_format(events).select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), chat_format.under_loss(F.col("formatted"), F.col("loss")).alias("l"))
    got = {r.conv_id: ([(t.role, t.text) for t in r.t], r.l) for r in made.collect()}
    assert got == {1: ([("user", "a+"), ("user", "b+")], ""), 2: ([("assistant", long)] * 2, long * 2), 3: ([], "")}


LONG = "".join(f"Line {i} of a long text, some words each.\n" for i in range(30_000))


def test_texts_of_over_a_mebibyte(spark, tmp_path):
    """Every operator that cuts long texts into pieces gives what it gives for the whole."""
    from tokenizers import Tokenizer

    rows = [(1, LONG), (2, LONG + "and a tail"), (3, "w" * (1 << 21)), (4, "short")]
    assert len(LONG) > 1 << 20
    docs = frame(spark, rows)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert near == {i: (len(shingles(t)), 1 if i == 2 else i) for i, t in rows}
    kept = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(docs).collect()}
    assert kept == {1: LONG, 2: "and a tail", 3: rows[2][1], 4: "short"}
    ranks, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), bpe_pattern()
    tokens = byte_bpe.encoding(ranks, pattern)
    for r in byte_bpe.encode(docs.where("doc_id <> 3"), ranks, pattern, and_decode=True).collect():
        text = dict(rows)[r.doc_id]
        assert bytes(r.decoded) == text.encode() and bytes(r.ids) == np.array(tokens.encode_ordinary(text), "<u4").tobytes()
    path = tokenizer_file("word_bpe_49k.json")
    made = token_files.write(docs.where("doc_id <> 3"), path, str(tmp_path / "f")).select("*")
    made.write.parquet(str(tmp_path / "m"))
    t = Tokenizer.from_file(path)
    for r in token_files.read(spark, spark.read.parquet(str(tmp_path / "m"))).collect():
        assert bytes(r.ids) == np.array(t.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids + [2], "<u4").tobytes()


def test_token_files_of_one_id(spark, tmp_path):
    """Rows that share an id fill several files, none lost; starts follow each other."""
    docs = spark.createDataFrame([(None, f"row {i}") for i in range(400)] + [(7, "")] * 300, "doc_id long, text string").repartition(6)
    token_files.SMALL_FILE_BYTES, held = 300, token_files.SMALL_FILE_BYTES
    try:
        token_files.write(docs, tokenizer_file("word_bpe_49k.json"), str(tmp_path / "f"), seq_len=8).write.parquet(str(tmp_path / "m"))
    finally:
        token_files.SMALL_FILE_BYTES = held
    manifest = spark.read.parquet(str(tmp_path / "m"))
    assert manifest.where("n_docs > 0").count() > 5
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.read(spark, manifest).collect())
    assert len(got) == 700 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:])) and [d for *_, d in got] == [None] * 400 + [7] * 300


def test_greatest_id_is_no_null(spark):
    line = "one line that repeats"
    got = line_dedup.line_dedup(spark.createDataFrame([(2**63 - 1, line), (None, line), (None, line + "\nown")], "doc_id long, text string").withColumn("LINE_doc", F.lit(1))).collect()
    assert sorted((str(r.doc_id), r.kept_text, r.LINE_doc) for r in got) == [(str(2**63 - 1), line, 1), ("None", "", 1), ("None", "own", 1)]


def empty_tokens(docs):
    ranks, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), bpe_pattern()
    return byte_bpe.encode(docs, ranks, pattern, and_decode=True)


def empty_files(docs, tmp_path):
    token_files.write(docs, tokenizer_file("word_bpe_49k.json"), str(tmp_path / "f")).write.parquet(str(tmp_path / "m"))
    return token_files.read(docs.sparkSession, docs.sparkSession.read.parquet(str(tmp_path / "m")))


@pytest.mark.parametrize("run", [near_dedup.near_duplicates, near_dedup.drop_near_duplicates, line_dedup.line_dedup, sharding.shard_by_bytes, fingerprints.fingerprints, substring_dedup.substring_dedup, empty_tokens])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_empty_files_and_logs(spark, tmp_path):
    assert empty_files(frame(spark, []), tmp_path).count() == 0
    log = spark.createDataFrame([], "conv_id long, seq long, op string, role string, text string, target long")
    assert chat_format.chat_format(log).count() == 0
