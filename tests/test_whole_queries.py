"""Registered queries over tables of a few rows against brute force: no row is left out by length or letters."""

import collections
import itertools

import pytest
from pyspark.sql import functions as F

from spanweave.plans import queries as linking

def test_masks_of_more_than_the_low_bits(spark):
    from spanweave.operators import segment

    q = spark.createDataFrame([(1, [f"t{i}" for i in range(15)])], "query_id long, tokens array<string>")
    assert segment.segmentation_rows(q).distinct().count() == 2**14
    got = segment.subset_rows(q).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert (got.rows, got.n) == (2**15 - 1, 2**15 - 1)


PAGES = {1: "Über Straßen und über Straßen", 2: "Año Nuevo", 3: "Café au lait", 4: "Plain title", 5: "Ünder", 6: "naïve", 8: ""}


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    spark.createDataFrame([(i, f"<html><title>{t}</title></html>") for i, t in PAGES.items()] + [(7, "none")], "page_id long, html string").write.parquet(str(at / "pages.parquet"))
    return str(at)


def typed(i, key):
    return key if i % 3 == 0 else key[:-1] if i % 3 == 1 else key + "xyz"


TOKENS = {i: typed(i, t.lower()).split() for i, t in PAGES.items() if t}


def test_word_subsets(spark, pages):
    want = collections.Counter((i, " ".join(c)) for i, w in TOKENS.items() for k in range(1, len(w) + 1) for c in itertools.combinations(w, k))
    got = linking.QUERIES["word_subsets"](spark, pages).collect()
    assert {(r.query_id, r.words): r.n for r in got} == want and len(got) == len(want)


def test_segmentations(spark, pages):
    want = collections.Counter((i, w[0] + "".join(g + x for g, x in zip(gaps, w[1:], strict=True))) for i, w in TOKENS.items() for gaps in itertools.product(" |", repeat=len(w) - 1))
    assert collections.Counter((r.query_id, r.cut) for r in linking.QUERIES["segmentations"](spark, pages).collect()) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_titles_in_any_letters(spark, pages):
    name = {i: t.replace(" ", "_") for i, t in PAGES.items() if t}
    to = {i: name[i + 1] if i % 5 == 0 else t for i, t in name.items()}
    got = linking.QUERIES["redirect_resolve"](spark, pages).collect()
    assert {(r.page_id, r.title, r.resolved) for r in got} == {(i, t, to[i]) for i, t in name.items()}
    key = {i: t.replace("_", " ").lower() for i, t in name.items()}
    want = set()
    for i, k in key.items():
        d, page = min((distance(typed(i, k), x), p) for p, x in key.items())
        if d <= 2:
            want.add((i, page, d, to[page]))
    assert {tuple(r) for r in linking.QUERIES["title_match"](spark, pages).collect()} == want and want
