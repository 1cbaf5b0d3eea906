"""Strict and relaxed ratings against gold, and precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Rate active mentions (``query_id``, ``ord``, ``position``, ``word_count``, ``surface``, ``link``).

    The first gold mention with the same link decides: same words are ``TP-strict``, others ``TP-relaxed``; no such gold ``FP``.
    """
    first = gold.groupBy("query_id", "link").agg(F.min_by("substring", "gold_ord").alias("gold_substring"))
    joined = predicted.join(first, ["query_id", "link"], "left")
    rating = F.when(F.col("gold_substring").isNull(), "FP").when(F.col("gold_substring") == F.col("surface"), "TP-strict").otherwise("TP-relaxed")
    return joined.select("query_id", "ord", "position", "word_count", "surface", "link", rating.alias("rating"))


def rate_gold(rated: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold mentions: ``matched``, ``FP-corresponding`` (inside a wrong mention's span; no miss) or ``FN``."""
    links = rated.groupBy("query_id", "link").agg(F.lit(True).alias("hit"))
    wrong = rated.where("rating = 'FP'").groupBy("query_id").agg(F.collect_list(F.struct(F.col("position").alias("p"), F.col("word_count").alias("n"))).alias("wrong"))
    joined = gold.join(links, ["query_id", "link"], "left").join(wrong, "query_id", "left")
    inside = F.exists("wrong", lambda m: (m["p"] <= F.col("position")) & (F.col("position") + F.col("word_count") <= m["p"] + m["n"]))
    rating = F.when(F.col("hit"), "matched").when(F.coalesce(inside, F.lit(False)), "FP-corresponding").otherwise("FN")
    return joined.select("query_id", "gold_ord", "position", "word_count", "substring", "link", rating.alias("rating"))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(rated: DataFrame, rated_gold: DataFrame) -> DataFrame:
    """One row: counts and six figures to six places (null where a denominator is 0)."""
    count = lambda r: F.count_if(F.col("rating") == r)
    p = rated.agg(count("TP-strict").alias("tp_s"), count("TP-relaxed").alias("tp_l"), count("FP").alias("fp"))
    both = p.join(rated_gold.agg(count("FN").alias("fn")))
    return figures(both)


def figures(counts: DataFrame) -> DataFrame:
    s, loose, fp, fn = (F.col(c) for c in ("tp_s", "tp_l", "fp", "fn"))
    out = counts.select(
        "tp_s", "tp_l", "fp", "fn", _ratio(s, s + loose + fp).alias("ps"), _ratio(s, s + fn).alias("rs"), _ratio(s + loose, s + loose + fp).alias("pl"), _ratio(s + loose, s + loose + fn).alias("rl")
    )
    mean = lambda a, b: F.try_divide(2 * F.col(a) * F.col(b), F.col(a) + F.col(b))
    six = lambda c: F.round(c, 6)
    return out.select(
        "tp_s", "tp_l", "fp", "fn", six("ps").alias("precision_strict"), six("rs").alias("recall_strict"), six(mean("ps", "rs")).alias("f1_strict"),
        six("pl").alias("precision_relaxed"), six("rl").alias("recall_relaxed"), six(mean("pl", "rl")).alias("f1_relaxed"),
    )


def evaluate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    rated = rate(predicted, gold)
    return f1(rated, rate_gold(rated, gold))
