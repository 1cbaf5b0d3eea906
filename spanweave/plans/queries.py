"""The registered queries: each operator or pipeline over its whole tables."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import knowledge, scoring, segment, titles, voting
from ..operators.cells import cells
from ..sources import sessions_xml, sinks, tables
from ..sources.stage import root, stage
from .pipelines import Linker

QUERIES = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Linker(spark, sf_dir))

    QUERIES[f.__name__] = run
    return run


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


@query
def dict_build(x):
    return x.dictionary.select("surface", "rank", "link", F.round("prob", 9).alias("prob"))


@query
def ngrams(x):
    return segment.ngrams(x.queries, 3)


@query
def ngrams_any_length(x):
    return segment.ngrams(x.queries).groupBy("word_count").agg(F.count("*").alias("n"), F.sum(F.length("surface")).alias("chars"))


@query
def dict_lookup(x):
    return x.candidates.select("query_id", "position", "word_count", "surface", "link0", "n_cands")


@query
def overlap_resolve(x):
    return x.mentions.select("query_id", "ord", "position", "word_count", "surface", "chosen")


@query
def overlap_first(x):
    return segment.first_crossing(x.mentions)


@query
def chosen_entities(x):
    return x.prior().where("chosen >= 0").select("query_id", "ord", "link", F.round("prob", 9).alias("prob"))


@query
def score_ratings(x):
    p = x.prior().where("chosen >= 0")
    return scoring.rate(p, x.gold).select("query_id", "ord", "link", "rating")


@query
def gold_ratings(x):
    p = x.prior().where("chosen >= 0")
    return scoring.rate_gold(scoring.rate(p, x.gold), x.gold).select("query_id", "gold_ord", "link", "rating")


@query
def baseline_f1(x):
    return x.score(x.prior(), canonical=False)


@query
def lookup_cascade(x):
    return x.cascaded.select("query_id", "position", "word_count", "surface", "matched", "turn")


@query
def cascade_f1(x):
    """Any n, stop words, lookup cascade and the first candidate; only gold links are made canonical, as in the pipeline this follows."""
    return x.score(stage(x.prior(segment.resolve_overlaps(x.cascaded)), "cascade", "query_id"))


@query
def fewest_candidates(x):
    return segment.fewest_candidates(x.candidates)


@query
def annotator_f1(x):
    found = segment.from_annotator(x.queries, tables.annotations(x.spark, x.sf_dir))
    return x.score(found, canonical=False)


@query
def clean_candidates(x):
    return segment.clean(x.mentions, x.dictionary).select("query_id", "ord", "surface", "chosen", "link", F.round("prob", 9).alias("prob"))


@query
def queries_with_gold(x):
    return segment.with_gold(x.queries, x.gold.where(F.col("substring").startswith("cold"))).select("query_id", "text")


@query
def xml_sessions(x):
    """Sessions with predictions, written as XML and read again."""
    path = f"{root(x.spark)}/xml-{uuid.uuid4().hex}"
    sinks.write_sessions_xml(sinks.annotated_sessions(x.queries, x.sessions, x.prior()), path)
    back = sessions_xml.read_sessions(x.spark, path, ordered=False)
    each = back.select("session_id", F.col("starttime").cast("int").alias("query_ord"), "text", F.posexplode_outer("annotations").alias("i", "a"))
    return each.select("session_id", "query_ord", "text", "i", F.col("a.span").alias("span"), F.col("a.target._VALUE").alias("link"))


@query
def candidate_limit(x):
    return voting.limit(x.dictionary, 5, 0.042).select("surface", "rank", "link")


@query
def surface_vote(x):
    return voting.surface_votes(voting.limit(x.dictionary, x.k, x.tau), x.rel).select("surface", "target", F.round("vote", 9).alias("vote"))


@query
def vote(x):
    total = F.aggregate("votes", F.lit(0.0), lambda a, c: a + c["vote"])
    return x.voted.select("query_id", "ord", F.round(total, 9).alias("votes"), F.size("votes").cast("bigint").alias("n"))


@query
def choose_epsilon(x):
    return voting.choose_epsilon(x.voted, x.epsilon)


@query
def choose_topk(x):
    return voting.choose_topk(x.voted, 10, 7)


@query
def relatedness(x):
    return x.rel.select("e1", "e2", F.round("rel", 9).alias("rel"))


@query
def coherence(x):
    return voting.coherence(x.prior(), x.rel).select("query_id", "ord", F.round("coherence", 9).alias("coherence"))


@query
def prune(x):
    kept, _ = voting.prune(x.prior(), x.rel, x.theta, True)
    return kept.select("query_id", "ord", "chosen")


@query
def prune_clean(x):
    kept, _ = voting.prune(x.prior(), x.rel, x.theta, False)
    return kept.select("query_id", "ord", "chosen")


@query
def query_coherence(x):
    _, total = voting.prune(x.prior(), x.rel, x.theta, True)
    return total.select("query_id", F.round("total", 12).alias("total"), "n_chosen")


@query
def confidence(x):
    kept, total = voting.prune(x.prior(), x.rel, x.theta, True)
    return voting.confidence(x.queries, kept, total)


@query
def improved_f1(x):
    return x.score(x.pruned(x.valid(x.prior()), x.theta)[0])


@query
def voting_f1(x):
    return x.score(x.pruned(x.valid(x.by_voting()), x.theta)[0])


@query
def session_history(x):
    return voting.session_history(x.mentions, x.sessions).select("query_id", "session_id", "query_ord", _joined("history"))


@query
def query_diff(x):
    return segment.query_diff(x.queries, x.sessions).select("query_id", "session_id", "query_ord", _joined("new_words"))


@query
def dp_choice(x):
    return voting.dp_choice(x.mentions, x.dictionary, x.rel, x.sessions)


@query
def dynamic_f1(x):
    return x.score(x.valid(x.pruned(x.by_dynamic(), x.dp_theta)[0]))


@query
def combined_f1(x):
    return x.combined_score()


@query
def combined_winners(x):
    return x.combined_winners().groupBy("winner").agg(F.count("*").alias("n"))


@query
def stopwords(x):
    w = F.split(F.lower("text"), " ")
    rows = tables.load(x.spark, x.sf_dir, "benchmark").select("item_id", F.array_join(segment.stopwords(w, ("the", "of", "de"), False), " ").alias("kept"))
    return rows


@query
def acceptable_words(x):
    w = tables.load(x.spark, x.sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return w.where(T.acceptable(F.col("word"))).select("item_id", "i", "word")


@query
def soft_fix(x):
    return tables.load(x.spark, x.sf_dir, "benchmark").select("item_id", T.soft_fix(F.col("text")).alias("fixed"))


@query
def singular_plural(x):
    w = x.dictionary.select("surface").distinct()
    return w.select("surface", T.pluralize(F.col("surface")).alias("plural"), T.singularize(T.pluralize(F.col("surface"))).alias("singular"))


@query
def hard_fix(x):
    return x.dictionary.select("surface").distinct().select("surface", T.hard_fix(F.concat(F.lit("The "), F.col("surface"), F.lit("'s!"))).alias("fixed"))


@query
def noun_phrases(x):
    w = tables.load(x.spark, x.sf_dir, "benchmark").select("item_id", titles.words_of(F.col("text")).alias("w"))
    return w.select("item_id", F.array_join(T.noun_phrases(F.col("w")), "|").alias("phrases"), F.array_join(T.chunks(F.col("w")), "|").alias("chunks"))


@query
def homogeneity(x):
    t = F.size(F.array_distinct(F.transform("tokens", T.tag)))
    return x.queries.select("query_id", F.greatest(1.5 - t / 2, F.lit(0.0)).alias("homogeneity"))


@query
def segment_score(x):
    tags = F.size(F.array_distinct(F.transform(F.split("surface", " "), T.tag)))
    alike = F.greatest(1.5 - tags / 2, F.lit(0.0))
    return x.candidates.select("query_id", "position", "word_count", F.round(3.0 * F.col("word_count") + 3.0 / F.col("n_cands") + alike + 3.0 * F.col("p0"), 6).alias("score"))


def _title_tokens(x):
    """Typed titles as queries: a query of n words has 2^(n-1) segmentations and 2^n - 1 subsets, so orders of up to 34 words are out of reach for any plan."""
    typed = tables.title_queries(x.spark, x.sf_dir)
    return typed.select("query_id", F.filter(F.split("text", " "), lambda t: t != "").alias("tokens"))


@query
def segmentations(x):
    return segment.segmentation_rows(_title_tokens(x))


@query
def word_subsets(x):
    return segment.subset_rows(_title_tokens(x))


@query
def unquote(x):
    url = F.concat(F.lit("http://en.wikipedia.org/wiki/"), F.replace(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("o"), F.lit("o+")))
    return tables.load(x.spark, x.sf_dir, "part").select("p_partkey", T.entity_name(url).alias("name"))


@query
def punctuation(x):
    return tables.load(x.spark, x.sf_dir, "benchmark").select("item_id", T.strip_punctuation(F.col("text")).alias("plain"), F.md5("text").alias("key"))


@query
def accents(x):
    return tables.load(x.spark, x.sf_dir, "benchmark").select("item_id", T.remove_accents(F.col("text")).alias("plain"))


@query
def match_score(x):
    w = x.dictionary.select("surface").distinct().where("instr(surface, ' ') > 0").select("surface", F.split("surface", " ").alias("w"))
    return w.select("surface", F.explode(F.array(*map(F.lit, ("red", "re", "in", "gizm", "ol", "bolt")))).alias("sub"), "w").select("surface", "sub", T.match_score(F.col("sub"), F.col("w")).alias("score"))


@query
def redirect_resolve(x):
    return titles.resolve(tables.titles(x.spark, x.sf_dir), tables.redirects(x.spark, x.sf_dir))


@query
def redirect_words(x):
    pages = tables.titles(x.spark, x.sf_dir)
    words = pages.select(F.col("title").alias("word")).union(tables.title_queries(x.spark, x.sf_dir).select("text"))
    return titles.expand(words, pages, tables.redirects(x.spark, x.sf_dir))


@query
def title_match(x):
    got = titles.match_title(tables.title_queries(x.spark, x.sf_dir), tables.titles(x.spark, x.sf_dir), tables.redirects(x.spark, x.sf_dir))
    return got.select("query_id", "page_id", "distance", "title")


def _word_queries(x):
    return tables.title_queries(x.spark, x.sf_dir).select("query_id", "text", titles.words_of(F.col("text")).alias("words"))


def _corpus(x):
    return tables.titles(x.spark, x.sf_dir).select(F.col("page_id").alias("doc_id"), F.replace("title", F.lit("_"), F.lit(" ")).alias("text"))


@query
def ft_and(x):
    return titles.full_text(_word_queries(x), _corpus(x), True)


@query
def ft_or(x):
    return titles.full_text(_word_queries(x), _corpus(x), False)


@query
def ft_or_best(x):
    return titles.best(_word_queries(x), _corpus(x))


@query
def title_cascade(x):
    pages, words = tables.titles(x.spark, x.sf_dir), _word_queries(x)
    kb = titles.kb_answers(words, pages, tables.properties(x.spark), tables.claims(x.spark, x.sf_dir))
    return titles.cascade(words, pages, tables.redirects(x.spark, x.sf_dir), kb)


@query
def title_greedy(x):
    return titles.greedy(_word_queries(x), tables.titles(x.spark, x.sf_dir), tables.redirects(x.spark, x.sf_dir))


@query
def title_project(x):
    pages = tables.titles(x.spark, x.sf_dir)
    return titles.project(titles.greedy(_word_queries(x), pages, tables.redirects(x.spark, x.sf_dir)), tables.title_queries(x.spark, x.sf_dir), pages)


@query
def title_rescore(x):
    return titles.rescore(_word_queries(x), tables.titles(x.spark, x.sf_dir))


@query
def deabbreviate(x):
    return titles.deabbreviate(tables.title_queries(x.spark, x.sf_dir), tables.titles(x.spark, x.sf_dir))


@query
def spell(x):
    w = x.dictionary.where("instr(surface, ' ') = 0").select(F.col("surface").alias("word")).distinct()
    typed = w.select(F.concat(F.substring("word", 1, 2), F.substring("word", 4, 20)).alias("word")).union(w).distinct()
    return titles.spell(typed, w)


@query
def dict_file(x):
    return knowledge.build_dictionary(tables.dictionary_file(x.spark, x.sf_dir), 64)


@query
def token_position(x):
    items = tables.load(x.spark, x.sf_dir, "benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("start"))
    return items.select("item_id", "start", T.token_at(F.col("text"), F.col("start")).alias("token"), T.token_at(F.col("text"), F.col("start"), True).alias("last"))


@query
def insert_check(x):
    w = x.dictionary.select("surface").distinct()
    short = F.regexp_replace("surface", "[aeio]", "")
    return w.select("surface", T.insert_check(short, F.col("surface")).alias("dropped"), T.insert_check(F.col("surface"), short).alias("longer"), T.insert_check(F.reverse("surface"), F.col("surface")).alias("reversed"))


@query
def longest_common(x):
    w = x.dictionary.where("instr(surface, ' ') = 0").select(F.col("surface").alias("a")).distinct()
    one = w.select(F.explode(F.array(*map(F.lit, ("gadgets", "ringlet", "oldest", "revolt")))).alias("b"), "a")
    return one.select("a", "b", T.longest_common(F.col("a"), F.col("b")).alias("common"))


def _options(x):
    """Of the unambiguous pages whose title begins with the first word of a typed title, the best by its other words in the summary and in the content."""
    pages = tables.snapshots(x.spark, x.sf_dir).where("NOT is_ambiguous")
    words = _word_queries(x).where("size(words) > 1").select("query_id", F.element_at("words", 1).alias("key"), F.slice("words", 2, F.size("words")).alias("words"))
    pages = pages.withColumn("key", F.try_element_at(titles.words_of(F.replace("title", F.lit("_"), F.lit(" "))), F.lit(1))).where("key IS NOT NULL")
    no = F.lit(0.0)

    def ranked(c: str, summary, content):
        got = cells(words, pages.select(F.col("page_id").alias("doc_id"), titles.words_of(F.col(c)).alias("words"), "key"), 1, doc_block=4_096)
        return got.select("query_id", F.col("doc_id").alias("page_id"), summary.alias("summary_rank"), content.alias("content_rank"))

    got = ranked("summary", F.col("rank"), no).unionByName(ranked("content", no, F.col("rank")))
    return got.join(pages.select("page_id", "title", "is_ambiguous"), "page_id")


@query
def disambiguation(x):
    return knowledge.disambiguate(_options(x))


def _kb_tokens(x):
    s = tables.load(x.spark, x.sf_dir, "supplier")
    words = F.array(F.lit("what"), F.when(F.col("s_suppkey") % 3 == 0, "nations").when(F.col("s_suppkey") % 3 == 1, "founded").otherwise("numb"), F.lit("of"), F.lit("country"))
    return s.select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("subject"), F.posexplode(words).alias("i", "token"))


@query
def break_word(x):
    return knowledge.break_words(_kb_tokens(x), tables.properties(x.spark))


@query
def kb_lookup(x):
    t = _kb_tokens(x)
    p = tables.properties(x.spark)
    return knowledge.kb_lookup(knowledge.break_words(t, p), t.select("query_id", "subject").distinct(), p, tables.claims(x.spark, x.sf_dir))


def _brand_titles(x):
    number = F.split("e", "#")[1].cast("bigint")
    return x.dictionary.select(F.col("link").alias("e")).distinct().where(number % 11 != 0).select(number.alias("page_id"), F.col("e").alias("title"))


def _brand_redirects(x):
    return _brand_titles(x).where("page_id % 5 = 0").select(F.col("page_id").alias("rd_from"), F.concat(F.lit("Brand#"), (F.col("page_id") + 1).cast("string")).alias("rd_title"))


@query
def dict_refresh(x):
    return knowledge.refresh(x.dictionary, _brand_titles(x), _brand_redirects(x)).select("surface", "rank", "link", "status")


@query
def dict_refresh_totals(x):
    return knowledge.refresh(x.dictionary, _brand_titles(x), _brand_redirects(x)).groupBy("status").agg(F.count("*").alias("n"))


@query
def canonical_links(x):
    fixes = _brand_redirects(x).select(F.concat(F.lit("Brand#"), F.col("rd_from").cast("string")).alias("link"), F.col("rd_title").alias("canonical"))
    return knowledge.canonical(x.dictionary.select("link").distinct().union(x.dictionary.select(F.concat("link", F.lit("_(disambiguation)"))).distinct()), fixes)


@query
def dict_export(x):
    return sinks.dictionary_lines(x.dictionary)


@query
def export_rows(x):
    return sinks.export_rows(x.queries, x.prior())


@query
def visualize(x):
    return sinks.layers(x.mentions)


@query
def run_diff(x):
    return sinks.run_diff(x.prior(), x.pruned(x.prior(), x.theta)[0])


@query
def segmentation_averages(x):
    m = x.mentions.groupBy("query_id").agg(F.avg("word_count").alias("w"), F.count("*").alias("n"))
    return m.agg(F.round(F.avg("w"), 6).alias("avg_words"), F.round(F.avg("n"), 6).alias("avg_mentions"))


@query
def word_frequency(x):
    w = x.queries.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("n").alias("total")))).select("word", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))
