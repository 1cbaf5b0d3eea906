"""Template matches against a brute-force matcher, on both ways of joining."""

import collections
import random

import pytest
import regex
from pyspark.sql import functions as F
from test_operators import EDGE, frame

from spanweave.llm import decontaminate as D


def typed(text):
    raw = regex.findall(f"{D.NUMBER}|{D.WORD}", text)
    units, out = D.UNITS.split("|"), []
    for i, w in enumerate(raw):
        number = lambda x: regex.match(r"\p{N}", x)
        kind = "<num>" if number(w) else "<name>" if regex.fullmatch(r"\p{Lu}\p{Ll}+", w) else "<unit>" if i and number(raw[i - 1]) and w.lower() in units else None
        out.append((kind or w.lower(), w.lower()))
    return out


def brute(docs, items):
    found = set()
    for item_id, text in set(items):
        it = typed(text or "")
        for doc_id, body in docs:
            dt = typed(body or "")
            lines = collections.defaultdict(list)
            for ip in range(len(it) - 4):
                for dp in range(len(dt) - 4):
                    if all(a[0] == b[0] for a, b in zip(it[ip : ip + 5], dt[dp : dp + 5], strict=True)) or all(a[1] == b[1] for a, b in zip(it[ip : ip + 5], dt[dp : dp + 5], strict=True)):
                        lines[dp - ip].append(ip)
            covered = set()
            for shift, places in lines.items():
                slots = lambda ip: [(*it[ip + j], dt[ip + shift + j][1]) for j in range(5) if it[ip + j][0].startswith("<")]  # noqa: E731, B023
                votes = collections.defaultdict(collections.Counter)
                for ip in places:
                    for k, i, d in slots(ip):
                        votes[k, i][d] += 1
                best = {s: max(v, key=lambda d: (v[d], d)) for s, v in votes.items()}  # noqa: B023
                for ip in places:
                    if all(best[k, i] == d for k, i, d in slots(ip)):
                        covered |= set(range(ip, ip + 5))
            if covered and 100 * len(covered) >= 80 * len(it):
                found.add((doc_id, item_id, len(it), len(covered)))
    return {max(same, key=lambda x: x[3]) for same in collections.defaultdict(list, _grouped(found)).values()}


def _grouped(found):
    out = collections.defaultdict(list)
    for x in found:
        out[x[:3]].append(x)
    return out


def result(spark, docs, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("item", F.lit("x"))
    got = [tuple(r) for r in D.matches(frame(spark, docs), bench, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed):
    rng = random.Random(seed)
    name = lambda: rng.choice("Ann Bob Tom Éva Zoë".split())
    number = lambda: rng.choice(["3", "14", "2.5", "1,000", "7"])
    word = lambda: rng.choice("has buys apples pears and how many kg km are left the WHO straße".split())
    sentence = lambda n: [rng.choice([name, number, word, word, word, word])() for _ in range(n)]
    items = [(k, " ".join(sentence(rng.choice([4, 5, 8, 20, 40])))) for k in range(12)] + [(3, "a second text of the third item in the table"), (None, "an item without an id has 3 words more"), (20, None), (21, "")]
    docs = []
    for i in range(60):
        body = (rng.choice(items)[1] or "").split()
        swap = {x: rng.choice([x, name(), number()]) for x in "Ann Bob Tom 3 14 7".split()}
        style = rng.randrange(4)
        if style == 1:
            body = [swap.get(x, x) for x in body]
        elif style == 2 and body:
            body[rng.randrange(len(body))] = "changed"
        elif style == 3:
            body = [x.upper() for x in body]
        docs.append((i, rng.choice([". ", "\n", " "]).join([" ".join(sentence(rng.randrange(6))), " ".join(body), " ".join(sentence(6))])))
    return docs + EDGE + [(None, "an item without an id has 30 words more")], items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = corpus(seed)
    want = brute(docs, items)
    assert len({d for d, *_ in want}) > 20
    assert result(spark, docs, items) == want
    assert result(spark, docs, items, broadcast_windows=0) == want


def test_renamed_questions(spark):
    item = "Ann has 3 apples. Ann buys 4 pears. How many fruits now?"
    renamed = item.replace("Ann", "Tom").replace("3", "31").replace("4", "14")
    docs = [(1, renamed), (2, item.upper()), (3, "So: " + item.lower()), (4, renamed.replace("Tom buys", "Bob sells")), (5, "Ann has 3 apples. Bob buys 4 pears, and none of it is a question")]
    docs += [(6, item.replace("3", "4")), (7, item.replace("fruits", "things")), (8, item + " " + "x" * (1 << 21)), (9, "y " * (1 << 20) + renamed)]
    assert {r[0] for r in result(spark, docs, [(7, item)])} == {1, 2, 3, 6, 7, 8, 9}


def test_documents_kept(spark):
    item = "we know Ann has 3 apples and 4 pears so how many fruits does Ann have in all of them"
    docs = [(1, "and " + item.replace("Ann", "Tom")), (3, "nothing of the kind"), (4, None), (5, ""), (6, "x " + item), (6, "clean row of a contaminated id"), (None, item), (None, "clean row of no id")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string")
    got = D.decontaminate(frame(spark, docs), bench)
    assert sorted(r.doc_id for r in got.collect()) == [3, 4, 5] and "size" in got.columns


def test_empty_tables(spark):
    bench = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    assert D.matches(frame(spark, []), bench).count() == 0
    assert D.matches(frame(spark, [(1, "one two three four five six")]), bench.limit(0)).count() == 0
    assert D.decontaminate(frame(spark, [(1, "a")]), bench.limit(0)).count() == 1
