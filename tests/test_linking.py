import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from spanweave.functions import text as T
from spanweave.operators import knowledge, scoring, segment, titles, voting
from spanweave.plans import oracles
from spanweave.plans import queries as linking
from spanweave.sources import sessions_xml, sheet, sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation supplier part orders lineitem pages benchmark".split()


@pytest.mark.parametrize("name", ["overlap_resolve", "baseline_f1", "choose_epsilon", "prune", "dp_choice", "query_diff", "title_match", "kb_lookup", "soft_fix", "noun_phrases"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(oracles.SQL[name]).df()
    got = linking.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist()), key=str) == sorted(map(tuple, want.values.tolist()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("words,kept", [(["a", "o", "b"], ["a", "b"]), (["o", "o"], ["o"]), (["or"], ["or"])])
def test_stopwords_as_deleted_while_iterating(spark, words, kept):
    assert one(spark, segment.stopwords(F.array(*map(F.lit, words)))) == kept


@pytest.mark.parametrize("before,after", [("karl rove's bad night", "karl rove bad night"), ("poker tournaments special offers", "poker tournament pecial offers")])
def test_soft_fix(spark, before, after):
    assert one(spark, T.soft_fix(F.lit(before))) == after


def test_unquote(spark):
    assert one(spark, T.unquote(F.lit("a+b%27"))) == "a+b'"
    assert one(spark, T.unquote(F.lit("100% of"))) == "100% of"
    assert one(spark, T.unquote(F.lit("100% of caf%C3%A9s %zz+"))) == "100% of cafés %zz+"


def test_remove_accents(spark):
    assert one(spark, T.remove_accents(F.lit("Ǻñ ﬁne ½ Łódź Tiếng 日本"))) == "An fine 12 odz Tieng "
    assert one(spark, T.remove_accents(F.lit("plain"))) == "plain" and one(spark, T.remove_accents(F.lit(None).cast("string"))) is None


def test_word_comparison(spark):
    assert one(spark, T.longest_common(F.lit("widget"), F.lit("gadgets"))) == "dget"
    assert one(spark, F.size(T.segmentations(F.array(*map(F.lit, "abcd"))))) == 8
    assert one(spark, F.size(T.subsets(F.array(*map(F.lit, "abc"))))) == 7


@pytest.mark.parametrize("spans,want", [
    ([(0, 2, 0.1), (1, 1, 0.9)], [(0, 2, 0)]),
    ([(0, 2, 0.5), (1, 2, 0.5)], [(0, 2, -1), (1, 2, 0)]),
    ([(0, 2, 0.5), (1, 2, 0.4)], [(0, 2, 0)]),
    ([(0, 2, 0.1), (1, 2, 0.9), (0, 1, 0.9)], [(0, 2, -1), (1, 2, 0)]),
])
def test_overlaps(spark, spans, want):
    rows = [(1, p, n, "s", "l", pr, 1) for p, n, pr in spans]
    c = spark.createDataFrame(rows, "query_id long, position int, word_count int, surface string, link0 string, p0 double, n_cands int")
    assert [(r.position, r.word_count, r.chosen) for r in segment.resolve_overlaps(c).orderBy("ord").collect()] == want


def test_dictionary_runs(spark):
    rows = [(i, s, f"0.{i + 1} L{i}") for i, s in enumerate("aabac")]
    got = knowledge.build_dictionary(spark.createDataFrame(rows, "line_no long, surface string, value string")).orderBy("surface", "rank")
    assert [(r.surface, r.link) for r in got.collect()] == [("a", "L0"), ("a", "L1"), ("b", "L2")]


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_dictionary_runs_across_blocks(spark, block):
    keys = "aaaabbbbbbaacccccccabd"
    rows = [(i, s, None if i % 7 == 6 else "0.5" if i % 11 == 10 else f"0.5 L{i} more") for i, s in enumerate(keys)]
    kept = [(s, f"L{i}") for i, s, v in rows if v and " " in v]
    runs = [(k, [x for _, x in same]) for k, same in itertools.groupby(kept, key=lambda x: x[0])][:-1]
    want = {k: v for k, v in reversed(runs)}
    got = knowledge.build_dictionary(spark.createDataFrame(rows, "line_no long, surface string, value string"), block).orderBy("surface", "rank").collect()
    assert [(r.surface, r.link) for r in got] == [(k, x) for k in sorted(want) for x in want[k]]


def test_published_figures(spark):
    r = scoring.figures(spark.createDataFrame([(353, 54, 399, 312)], "tp_s long, tp_l long, fp long, fn long")).first()
    assert [round(x, 4) for x in r[4:]] == [0.438, 0.5308, 0.4799, 0.505, 0.5661, 0.5338]


def test_prune_unsets_by_place_among_the_chosen(spark):
    rows = [(1, 1, 0, 1, "x", -1, None, None), (1, 2, 1, 1, "y", 0, "A", 0.9), (1, 3, 2, 1, "z", 0, "B", 0.1)]
    m = spark.createDataFrame(rows, "query_id long, ord int, position int, word_count int, surface string, chosen int, link string, prob double")
    rel = spark.createDataFrame([("A", "C", 0.1)], "e1 string, e2 string, rel double")
    left = lambda compat: [r.chosen for r in voting.prune(m, rel, 0.3, compat)[0].orderBy("ord").collect()]
    assert left(True) == [-1, -1, 0]
    assert left(False) == [-1, 0, -1]


TITLES = [(1, "Red_apple_pie"), (2, "Apple"), (3, "Blue_river_bank"), (4, "River_song")]


def title_frames(spark, texts):
    queries = spark.createDataFrame([(i, t, t.split()) for i, t in enumerate(texts)], "query_id long, text string, words array<string>")
    return queries, spark.createDataFrame(TITLES, "page_id long, title string"), spark.createDataFrame([], "rd_from long, rd_title string")


def test_title_cascade(spark):
    got = titles.cascade(*title_frames(spark, ["red apple pies", "pie red", "nice river songs", "nothing"])).collect()
    assert {(r.query_id, r.page_id, r.method) for r in got} == {(0, 1, "title"), (1, 1, "all"), (2, 4, "any")}


def test_title_cascade_by_last_word_spelling_and_knowledge(spark):
    queries, pages, redirects = title_frames(spark, ["one two three aple", "zzzz yyyy bluee", "founded river bank blue"])
    properties = spark.createDataFrame([("P3", "founded", 1)], "pid string, break_word string, ord int")
    claims = spark.createDataFrame([("Blue river bank", "P3", "+1990", "time"), ("Blue river bank", "P4", "x", "item")], "subject string, property string, object string, datatype string")
    kb = titles.kb_answers(queries, pages, properties, claims)
    assert [tuple(r) for r in kb.collect()] == [(2, "+1990")]
    got = titles.cascade(queries, pages.union(spark.createDataFrame([(9, "Blue")], "page_id long, title string")), redirects, kb).collect()
    assert {(r.query_id, r.page_id, r.method) for r in got} == {(0, 2, "word"), (1, 9, "word"), (2, None, "kb")}
    far = spark.createDataFrame([(5, "zz abcdefgx", ["zz", "abcdefgx"])], "query_id long, text string, words array<string>")
    page = spark.createDataFrame([(7, "Abcdefgh long name"), (8, "Abcdefgh")], "page_id long, title string")
    assert [tuple(r) for r in titles.corrected_last(far, spark.createDataFrame([("abcdefgh",), ("long",)], "word string")).collect()] == [(5, "abcdefgh")]
    assert {(r.query_id, r.page_id, r.method) for r in titles.cascade(far, page, redirects).collect()} == {(5, 8, "word")}


def test_projected_titles(spark):
    queries, pages, redirects = title_frames(spark, ["my blue river bank song apple", "apple"])
    found = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (1, 0, 1)], "query_id long, round int, page_id long")
    got = titles.project(found, queries, pages).collect()
    assert {(r.query_id, r.round, r.position, r.word_count, r.substring) for r in got} == {(0, 1, 1, 3, "blue river bank"), (0, 2, 5, 1, "apple"), (1, 0, 0, 1, "apple")}


def test_layers(spark):
    rows = [(1, 1, 0, 3, "a b c"), (1, 2, 1, 2, "b c"), (1, 3, 3, 1, "d"), (1, 4, 0, 1, "a"), (1, 5, 2, 1, "c")]
    got = sinks.layers(spark.createDataFrame(rows, "query_id long, ord int, position int, word_count int, surface string")).collect()
    assert {(r.layer, r.line) for r in got} == {(1, "[a b c] [d]"), (2, "[a] [b c]"), (3, "[c]")}


def test_canonical_links(spark):
    fixes = spark.createDataFrame([("A", "B"), ("C", "D%20E")], "link string, canonical string")
    rows = spark.createDataFrame([(1, "A"), (2, "A_(disambiguation)"), (3, "C"), (4, "X"), (5, None)], "query_id long, link string")
    assert {tuple(r) for r in knowledge.validate(rows, fixes).select("query_id", "link").collect()} == {(1, "B"), (2, "B"), (3, "D E"), (4, "X"), (5, None)}


def test_titles_taken_greedily(spark):
    got = titles.greedy(*title_frames(spark, ["apple", "song river apple", "nothing here"])).collect()
    assert {(r.query_id, r.round, r.page_id) for r in got} == {(0, 0, 2), (1, 1, 4), (1, 2, 2)}


def test_noun_phrases(spark):
    words = F.array(*map(F.lit, "the old bank of blue rivers was flooded".split()))
    assert one(spark, T.noun_phrases(words)) == ["old bank of blue rivers"]
    assert one(spark, T.chunks(words)) == ["old bank", "blue rivers was flooded"]


def test_sheet(spark, tmp_path):
    import zipfile
    import xml.etree.ElementTree as ET

    queries = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["<d>"])], "query_id long, words array<string>")
    spans = spark.createDataFrame([(1, 1, 2, "B_C", "strict"), (1, 2, 1, "C", "wrong")], "query_id long, position int, word_count int, link string, rating string")
    sheet.export_sheet(queries, spans, spans.limit(0), str(tmp_path / "x.ods"))
    root = ET.fromstring(zipfile.ZipFile(tmp_path / "x.ods").read("content.xml"))
    lines = [[c.findtext(".//{*}p") for c in r if "covered" not in c.tag] for r in root.iter("{urn:oasis:names:tc:opendocument:xmlns:table:1.0}table-row")]
    assert lines == [[None], ["a", "b", "c"], ["-", "B_C"], ["-", "-", "-"], [None], ["<d>"], ["-"], ["-"]]
    sheet.export_sheet(queries, spans, spans.limit(0), str(tmp_path / "y.ods"), "http://x/?a=1&b=")
    root = ET.fromstring(zipfile.ZipFile(tmp_path / "y.ods").read("content.xml"))
    assert [(a.text, a.get("{http://www.w3.org/1999/xlink}href")) for a in root.iter("{urn:oasis:names:tc:opendocument:xmlns:text:1.0}a")] == [("B_C", "http://x/?a=1&b=B_C")]
    assert 'office:value-type="float" office:value="1.5"' in sheet._cell(1.5)


def test_redirects_of_words(spark):
    pages = spark.createDataFrame([(1, "NY"), (2, "O''Hara"), (3, "LA")], "page_id long, title string")
    to = spark.createDataFrame([(1, "New_York''s"), (4, "x")], "rd_from long, rd_title string")
    assert {tuple(r) for r in titles.resolve(pages, to).select("page_id", "resolved").collect()} == {(1, "New_York's"), (2, "O'Hara"), (3, "LA")}
    words = spark.createDataFrame([("NY",), ("LA",), ("none",), ("NY",)], "word string")
    assert sorted(tuple(r) for r in titles.expand(words, pages, to).collect()) == [("LA", "LA"), ("NY", "New_York''s"), ("NY", "New_York''s"), ("none", "none")]

SESSIONS = """<webscope><session id="s1"><query starttime="x"><text>big "red" apple's pie</text>
<annotation main="true"><span>apple's pie</span><target wiki-id="1">http://en.wikipedia.org/wiki/Apple_pie</target></annotation><annotation><span>big</span></annotation></query>
<query starttime="2"><text>plain</text></query></session>
<session id="s1"><query starttime="3"><text>big apple</text><annotation><span>pear</span><target wiki-id="2">http://en.wikipedia.org/wiki/Pear</target></annotation>
<annotation><span>apple</span><target wiki-id="3">http://en.wikipedia.org/wiki/Apple</target></annotation></query></session></webscope>"""


def test_sessions_read(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SESSIONS)
    queries = sessions_xml.read_sessions(spark, str(tmp_path / "s.xml"))
    assert sorted((r.session_ord, r.query_ord, r.session_id, r.text) for r in queries.collect()) == [(0, 0, "s1", "big red apple's pie"), (0, 1, "s1", "plain"), (1, 0, "s1", "big apple")]
    gold = sessions_xml.gold_spans(queries).collect()
    assert [(r.session_ord, r.position, r.word_count, r.substring, r.link) for r in gold] == [(0, 2, 2, "apple's pie", "Apple_pie")]


def test_sessions_written(spark, tmp_path):
    rows = spark.createDataFrame([("s1", [("a & b",)])], "_id string, query array<struct<text:string>>")
    sinks.write_sessions_xml(rows, str(tmp_path / "out"))
    back = sessions_xml.read_sessions(spark, str(tmp_path / "out")).collect()
    assert [(r.session_id, r.text) for r in back] == [("s1", "a & b")]


def test_small_files(spark, tmp_path):
    (tmp_path / "titles").write_text("Apple_pie\tx\nPear\n\n")
    assert [r.title for r in sessions_xml.read_titles(spark, str(tmp_path / "titles")).collect()] == ["Apple_pie", "Pear"]
    (tmp_path / "ids").write_text("P21\nP3\nP3\n\nP9\n")
    described = spark.createDataFrame([("P21", "Sex", ["gender", "Male"]), ("P3", "Country", None), ("P4", "unused", [])], "pid string, label string, aliases array<string>")
    got = sessions_xml.read_properties(spark, str(tmp_path / "ids"), described).orderBy("ord").collect()
    assert [(r.pid, r.break_word) for r in got] == [("P3", "country"), ("P21", "sex"), ("P21", "gender"), ("P21", "male")]
    fixes = spark.createDataFrame([("A", "B")], "link string, canonical string")
    sinks.write_corrections(fixes, str(tmp_path / "fixes"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "fixes")).collect()] == [("A", "B")]
    lines = [f"s{i // 3}\t0.5 L{i}" for i in range(9)]
    (tmp_path / "dictionary").write_text("\n".join(lines) + "\n")
    read = knowledge.build_dictionary(sessions_xml.read_dictionary_lines(spark, str(tmp_path / "dictionary")))
    assert {(r.surface, r["rank"], r.link) for r in read.collect()} == {(f"s{i // 3}", i % 3 + 1, f"L{i}") for i in range(6)}
