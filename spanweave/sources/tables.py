"""Logical tables (dictionary, queries, gold, relatedness, titles, knowledge base) from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import discard, once, stage


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_priors(counts: DataFrame) -> DataFrame:
    """``surface``, ``link``, ``n`` to a dictionary: share of the surface's count, best first."""
    whole = Window.partitionBy("surface")
    prob = F.col("n").cast("double") / F.sum("n").over(whole).cast("double")
    rank = F.row_number().over(whole.orderBy(F.desc("n"), "link"))
    return counts.select("surface", rank.alias("rank"), "link", prob.alias("prob"))


def mention_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces: names of parts, their single words, and reversed names of even keys; links: brands."""
    words = F.split("p_name", " ")
    forms = F.concat(F.array("p_name"), words, F.when(F.col("p_partkey") % 2 == 0, F.array(F.array_join(F.reverse(words), " "))).otherwise(F.array().cast("array<string>")))
    counts = load(spark, sf_dir, "part").select(F.explode(forms).alias("surface"), F.col("p_brand").alias("link")).groupBy("surface", "link").agg(F.count("*").alias("n"))
    return with_priors(counts)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a query with its names and brands in order; stored once in buckets of queries, as all tables of queries come from it."""
    between: list[DataFrame] = []
    got = once(lambda: _items(spark, sf_dir, between), spark, sf_dir, "items", "query_id")
    for x in between:
        discard(x)
    return got


def _items(spark: SparkSession, sf_dir: str, between: list[DataFrame]) -> DataFrame:
    """Two steps, each with one shuffle of narrow rows; ``between`` gets the table that the second reads.

    Lines of one number and part differ in nothing that is kept, so the other columns put them in order only where a part's key repeats.
    """
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    repeats = not part.groupBy("p_partkey").count().where("count > 1").isEmpty()
    order = ["l_linenumber", "l_partkey", *(("l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate") if repeats else ())]
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), *order)
    rows = stage(line.join(part, line.l_partkey == part.p_partkey).select("query_id", *order, "p_name", "p_brand"), "item-rows")
    between.append(rows)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")
    got = dealt.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*order, "p_name", "p_brand"))).alias("items"))
    return got.select("query_id", F.col("items.p_name").alias("names"), F.col("items.p_brand").alias("brands"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id``, ``text``, ``tokens``: the names of an order's items."""
    text = F.array_join("names", " ")
    return items(spark, sf_dir).select("query_id", text.alias("text"), F.split(text, " ").alias("tokens"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id``, ``session_id`` and ``query_ord`` (from 1): a customer's orders by date."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("session_id"), F.row_number().over(w).alias("query_ord"))


def gold_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand of each item at the place of its two words, a query's in one list ``gs``; and the ``tokens`` of its text."""
    one = lambda x, i: F.struct(i.alias("gold_ord"), (i * 2).alias("position"), F.lit(2).alias("word_count"), x["names"].alias("substring"), x["brands"].alias("link"))
    return items(spark, sf_dir).select("query_id", F.split(F.array_join("names", " "), " ").alias("tokens"), F.transform(F.arrays_zip("names", "brands"), one).alias("gs"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gold_lists``, one row a span."""
    return gold_lists(spark, sf_dir).select("query_id", F.inline("gs"))


def relatedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the orders of two brands; pairs whose numbers sum to a multiple of 7 are missing."""
    at = items(spark, sf_dir).select(F.array_distinct("brands").alias("held"))
    n = at.select(F.explode("held").alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    both = at.select("held", F.explode("held").alias("e1")).select("e1", F.explode("held").alias("e2")).groupBy("e1", "e2").agg(F.count("*").alias("both"))
    number = lambda c: F.split(c, "#")[1].cast("int")
    full = both.join(n.toDF("e1", "n1"), "e1").join(n.toDF("e2", "n2"), "e2").where((number("e1") + number("e2")) % 7 != 0)
    return full.select("e1", "e2", (F.col("both").cast("double") / (F.col("n1") + F.col("n2") - F.col("both")).cast("double")).alias("rel"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id``, ``title`` of pages that have one, in any letters, blanks as underscores."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    got = load(spark, sf_dir, "pages").select("page_id", F.replace(title, F.lit(" "), F.lit("_")).alias("title"))
    return got.where("title <> ''")


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page leads to the title of the page after it, where there is one."""
    t = titles(spark, sf_dir)
    return t.where("page_id % 5 = 0").select(F.col("page_id").alias("rd_from"), (F.col("page_id") + 1).alias("page_id")).join(t, "page_id").select("rd_from", F.col("title").alias("rd_title"))


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id``, ``text``: titles as typed: right, one letter short, or three too long."""
    text = F.lower(F.replace("title", F.lit("_"), F.lit(" ")))
    typed = F.when(F.col("page_id") % 3 == 0, text).when(F.col("page_id") % 3 == 1, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(F.concat(text, F.lit("xyz")))
    return titles(spark, sf_dir).select(F.col("page_id").alias("query_id"), typed.alias("text"))


def corrections(dictionary: DataFrame) -> DataFrame:
    """``link`` and ``canonical``: of brands whose number ends in 5 or 0, the one before."""
    number = F.split("link", "#")[1].cast("int")
    return dictionary.select("link").distinct().where(number % 5 == 0).select("link", F.concat(F.lit("Brand#"), (number - 1).cast("string")).alias("canonical"))


def typed_queries(queries: DataFrame) -> DataFrame:
    """``query_id``, ``tokens``: queries as people type them, some words in the plural, with marks, or single letters between."""
    at = lambda i: (F.col("query_id") + i) % 5
    typed = F.transform("tokens", lambda w, i: F.when(at(i) == 0, F.concat(w, F.lit("s"))).when(at(i) == 1, F.concat(w, F.lit("!"))).otherwise(w))
    return queries.select("query_id", F.concat(typed, F.when(F.col("query_id") % 3 == 0, F.array(F.lit("o"), F.lit("r"), F.lit("o"))).otherwise(F.array().cast("array<string>"))).alias("tokens"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an annotator, as a snapshot: every second item of a query at its place in the text, some with the brand of another."""
    each = items(spark, sf_dir).select("query_id", "names", F.posexplode(F.arrays_zip("names", "brands")).alias("i", "x")).where("i % 2 = 0")
    start = F.length(F.array_join(F.slice("names", 1, F.col("i")), " ")) + F.when(F.col("i") > 0, 1).otherwise(0)
    link = F.when((F.col("query_id") + F.col("i")) % 5 == 0, "Brand#11").otherwise(F.col("x.brands"))
    return each.select("query_id", start.alias("start"), F.col("x.names").alias("surface"), link.alias("link"), F.lit(1.0).alias("prob"))


def dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a dictionary file: parts in order of their keys, with brands and priors; some lines lack a link."""
    line = F.when(F.col("p_partkey") % 10 == 0, F.lit("0.5")).otherwise(F.concat(F.format_number(1 / (F.col("p_size") + 1), 4), F.lit(" "), F.col("p_brand"), F.lit(" rest")))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.element_at(F.split("p_name", " "), 1).alias("surface"), line.alias("value"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id``, ``title``, ``summary``, ``content``, ``is_ambiguous`` of pages: head line, text without tags, and titles of up to four words."""
    plain = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    got = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("t"), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("summary"), plain.alias("content"))
    return got.where("t <> ''").select("page_id", F.replace("t", F.lit(" "), F.lit("_")).alias("title"), "summary", "content", (F.size(F.split("t", " ")) <= 4).alias("is_ambiguous"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, property, object, datatype: suppliers and nations with their places and balances."""
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    at = s.join(n, s.s_nationkey == n.n_nationkey)
    return (
        at.select(F.col("s_name").alias("subject"), F.lit("P1").alias("property"), F.col("n_name").alias("object"), F.lit("item").alias("datatype"))
        .union(at.select("s_name", F.lit("P3"), F.concat(F.lit("+"), (F.col("s_suppkey") % 28 + 1990).cast("string")), F.lit("time")))
        .union(at.select("s_name", F.lit("P4"), F.col("s_suppkey").cast("string"), F.lit("quantity")))
        .union(n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", F.lit("P2"), "r_name", F.lit("item")))
    )


#: Properties of the small knowledge base with the words that name them, in order.
PROPERTIES = [("P1", "nation", 1), ("P1", "country", 2), ("P2", "region", 3), ("P2", "continent", 4), ("P3", "founded", 5), ("P4", "number", 6), ("P4", "country", 7)]


def properties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROPERTIES, "pid string, break_word string, ord int")
