"""Passages, paragraphs and copies against brute force."""

import collections
import random

import pytest
from test_operators import EDGE, frame, words

from spanweave.llm import substring_dedup


def brute(rows):
    """Removals as the operator states them, by comparing everything with everything."""
    texts = collections.defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            texts[i].add(t)
    docs = [(i, t, words(t)) for i, ts in texts.items() for t in ts]
    sequences = collections.defaultdict(set)
    for i, _, w in docs:
        if len(w) >= 50:
            sequences[tuple(w)].add(i)
    keep = {(i, t): min(sequences[tuple(w)]) for i, t, w in docs if len(w) >= 50 and min(sequences[tuple(w)]) < i}
    out = {(i, 0, len(w), keep[i, t], "copy") for i, t, w in docs if (i, t) in keep}
    docs = [x for x in docs if x[:2] not in keep]
    holders = collections.defaultdict(set)
    for i, _, w in docs:
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    starts = collections.defaultdict(set)
    for i, _, w in docs:
        for k in range(len(w) - 49):
            least = min(holders[tuple(w[k : k + 50])])
            if least < i:
                starts[i, least].add(k)
    for (i, least), s in starts.items():
        for a in s:
            if a - 1 not in s:
                z = a
                while z + 1 in s:
                    z += 1
                out.add((i, a, z + 50, least, "passage"))
    lines = []
    for i, t, _ in docs:
        at = 0
        for line in t.split("\n"):
            w = words(line)
            if len(w) >= 50:
                lines.append((i, at, len(w), {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
            at += len(w)
    group = list(range(len(lines)))
    for x, a in enumerate(lines):
        for y in range(x):
            b = lines[y][3]
            if 100 * len(a[3] & b) >= 80 * len(a[3] | b):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    least = {g: min(line[0] for line, h in zip(lines, group, strict=True) if h == g) for g in group}
    out |= {(i, a, a + n, least[g], "paragraph") for (i, a, n, _), g in zip(lines, group, strict=True) if least[g] < i}
    return out


def result(spark, rows):
    got = [tuple(r) for r in substring_dedup.substring_dedup(frame(spark, rows)).select("doc_id", "start_word", "end_word", "keep_doc_id", "kind").collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed):
    """Documents that quote, cut, glue, edit and copy each other."""
    rng = random.Random(seed)
    some = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passages = [some(rng.choice([49, 50, 51, 60, 90, 200])) for _ in range(12)]
    rows = []
    for i in range(70):
        kind, body = rng.randrange(5), some(rng.choice([5, 30, 80]))
        for p in rng.sample(passages, rng.randrange(3)):
            a = rng.choice([0, 0, 0, rng.randrange(len(p) - 45)])
            body += p[a:] + rng.choice([[], ["\n"], some(20)])
        if kind == 0 and rows:
            body = rng.choice(rows)[1].split(" ")
        elif kind == 1 and rows:
            body = rng.choice(rows)[1].split(" ")
            body[rng.randrange(len(body))] = "Edited"
        rows.append((rng.choice([i, i, i, max(i - 1, 0)]), " ".join(body)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + EDGE
    want = brute(rows)
    assert {k for *_, k in want} == {"copy", "paragraph", "passage"}
    assert result(spark, rows) == want


def test_texts_of_several_pieces(spark):
    """A text of over a mebibyte that holds a passage of a short one, far from its start; words of any length."""
    rng = random.Random(3)
    long = [f"long{rng.randrange(10**9)}" for _ in range(120_000)] + ["w" * 700_000]
    passage = [f"p{i}" for i in range(55)]
    rows = [(1, " ".join(["start", *passage, "end"])), (2, " ".join(long[:100_000] + passage + long[100_000:])), (3, " ".join(long[50_000:50_060]))]
    assert len(rows[1][1]) > 2 << 20
    assert result(spark, rows) == brute(rows) == {(2, 100_000, 100_055, 1, "passage"), (3, 0, 60, 2, "passage")}


def test_removed_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    own = " ".join(f"own{i}" for i in range(40))
    rows = [(1, "x " + passage), (2, own + "\t" + passage.upper() + " this\nand that"), (2, None), (3, "near\t" + passage), (4, passage + " " + passage), *EDGE]
    docs = frame(spark, rows)
    got = substring_dedup.remove(docs, substring_dedup.substring_dedup(docs)).collect()
    want = [(1, "x " + passage), (2, own + "\t this\nand that"), (2, None), (3, ""), (4, ""), *EDGE]
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(want)


def test_empty_table(spark):
    docs = frame(spark, [])
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert substring_dedup.remove(docs, substring_dedup.substring_dedup(docs)).count() == 0
