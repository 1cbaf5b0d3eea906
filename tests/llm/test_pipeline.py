"""The five stages together against a brute-force version, after the classifier of the first."""

import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F
from test_operators import EDGE, LOW, rows, shingles  # noqa: F401

import corpus_pipeline
from spanweave.llm import byte_bpe
from spanweave.llm.queries import bpe_pattern, tokenizer_file

ITEM = "we know Ann has 3 apples and 4 pears so how many fruits does Ann have in all of them"


def line_dedup(docs):
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOW)
    number = lambda i: 2**63 - 1 if i is None else i
    holders = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(number(i))
    gone = lambda i, x: len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != number(i)
    return [(i, t and "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in docs]


def near_dedup(docs):
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    smallest = {i: i for i, _ in sets}
    moved = True
    while moved:
        moved = False
        for i, s in sets:
            for j, t in sets:
                if s and t and 100 * len(s & t) >= corpus_pipeline.NEAR_LIMIT * len(s | t) and smallest[i] < smallest[j]:
                    smallest[j], moved = smallest[i], True
    return [(i, t) for i, t in docs if i is None or smallest[i] == i]


def test_pipeline(spark, rows, tmp_path):  # noqa: F811
    docs = [(i, t, "en", None, len(t or "")) for i, t in rows]
    docs += [(1000 + i, f"scum {'scum ' * (i % 5)}of word{i % 7} number{i}", "en", "s", 0) for i in range(60)]
    docs += [(2000, "before it " + ITEM.replace("Ann", "Tom").replace("3", "31"), "en", "s", 0), (2001, "a clean text of some words about fruits", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, 1, int(i is not None and 1000 <= i < 2000)) for i, *_ in docs if i is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, ITEM), (8, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    first = corpus_pipeline.toxic(spark, corpus_pipeline.table(spark, str(tmp_path), "documents"), str(tmp_path)).select("doc_id", "text")
    kept = [(r.doc_id, r.text) for r in first.collect()]
    assert not [i for i, _ in kept if i is not None and 1000 <= i < 2000] and {2000, 2001} <= {i for i, _ in kept}
    want = [(i, t or "") for i, t in near_dedup(line_dedup(kept)) if i != 2000]
    tokens = byte_bpe.encoding(tokenizer_file("byte_bpe_multi_50k.tiktoken"), bpe_pattern())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, t, tokens.encode_ordinary(t)) for i, t in want]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == collections.Counter(
        (i, len(x), digest(np.array(x, "<u4").tobytes()), digest(t.encode())) for i, t, x in ids
    )


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    """No documents, then documents whose other columns are named as the operators name their own."""
    extra = ["gone", "d", "t", "h", "n", "kept", "label", "score", "line_gone", "words"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    for name, docs in (("none", []), ("some", [(i, f"some clean text of number {i} in other words {i * 7}", "en", None, 1, *extra) for i in (1, 2, None)] + [(4, None, None, None, None, *extra)])):
        at = tmp_path / name
        spark.createDataFrame(docs, kind).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        held = spark.read.parquet(str(at / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            held = stage(spark, held, str(at))
            assert held.columns == [c.split()[0] for c in kind.split(", ")]
        assert sorted(held.collect(), key=str) == sorted(spark.read.parquet(str(at / "documents.parquet")).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).collect(), key=str)
        assert corpus_pipeline.run(spark, str(at)).count() == len(docs)
