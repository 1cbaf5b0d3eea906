"""Results as dictionary lines, sheet rows, terminal layers, annotated XML and differences of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary_lines(dictionary: DataFrame) -> DataFrame:
    """Text lines ``surface``, tab, prior and link, as the loader reads them."""
    prob = F.format_number("prob", 6)
    return dictionary.select("surface", "rank", F.concat(F.col("surface"), F.lit("\t"), prob, F.lit(" "), F.col("link")).alias("line"))


def export_rows(queries: DataFrame, predicted: DataFrame) -> DataFrame:
    """For a sheet: a query's text and its active mentions by position as ``surface=link``."""
    one = F.struct("position", "ord", F.concat("surface", F.lit("="), "link").alias("cell"))
    got = predicted.where("chosen >= 0").groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    return queries.join(got, "query_id", "left").select("query_id", "text", F.coalesce(F.array_join(F.transform("m", lambda c: c["cell"]), "|"), F.lit("")).alias("cells"))


def layers(mentions: DataFrame) -> DataFrame:
    """Terminal lines of a query: mentions by position, each on the first line whose mentions end before it."""
    one = F.struct("position", "ord", "word_count", "surface")
    got = mentions.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    state = "struct<ends:array<int>,out:array<int>>"
    start = F.struct(F.array().alias("ends"), F.array().alias("out")).cast(state)

    def step(s, m):
        free = F.filter(F.sequence(F.lit(1), F.size(s["ends"]) + 1), lambda i: F.coalesce(F.get(s["ends"], i - 1), F.lit(0)) <= m["position"])
        at, end = F.element_at(free, 1), (m["position"] + m["word_count"]).cast("int")
        ends = F.when(at > F.size(s["ends"]), F.array_append(s["ends"], end)).otherwise(F.transform(s["ends"], lambda e, i: F.when(i + 1 == at, end).otherwise(e)))
        return F.struct(ends.alias("ends"), F.array_append(s["out"], at).alias("out")).cast(state)

    placed = got.select("query_id", F.inline(F.arrays_zip("m", F.aggregate("m", start, step)["out"].alias("layer")))).select("query_id", "layer", "m")
    lines = placed.groupBy("query_id", "layer").agg(F.sort_array(F.collect_list(F.col("m"))).alias("m"))
    return lines.select("query_id", "layer", F.array_join(F.transform("m", lambda c: F.concat(F.lit("["), c["surface"], F.lit("]"))), " ").alias("line"))


def run_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions whose link differs between two runs, or that one run lacks."""
    side = lambda df, c: df.select("query_id", "ord", F.col("link").alias(c))
    both = side(old, "old_link").join(side(new, "new_link"), ["query_id", "ord"], "full")
    return both.where(~F.col("old_link").eqNullSafe(F.col("new_link")))


def annotated_sessions(queries: DataFrame, sessions: DataFrame, predicted: DataFrame) -> DataFrame:
    """``_id`` and ``query`` of each session: its queries in order with all their mentions, those without a choice as a span alone."""
    target = F.when(F.col("chosen") >= 0, F.struct(F.col("link").alias("_VALUE")))
    one = F.struct("position", "ord", F.struct(F.col("surface").alias("span"), target.alias("target")).alias("a"))
    found = predicted.groupBy("query_id").agg(F.collect_list(one).alias("m"))
    marks = found.select("query_id", F.transform(F.array_sort("m", lambda x, y: F.when(x["position"] < y["position"], -1).when(x["position"] > y["position"], 1).otherwise(x["ord"] - y["ord"])), lambda m: m["a"]).alias("annotation"))
    rows = queries.join(sessions, "query_id").join(marks, "query_id", "left")
    each = F.struct(F.col("query_ord"), F.struct(F.col("query_ord").cast("string").alias("_starttime"), "text", "annotation").alias("q"))
    by = rows.groupBy(F.col("session_id").cast("string").alias("_id")).agg(F.collect_list(each).alias("q"))
    return by.select("_id", F.transform(F.array_sort("q", lambda x, y: x["query_ord"] - y["query_ord"]), lambda q: q["q"]).alias("query"))


def write_sessions_xml(annotated: DataFrame, path: str) -> None:
    """``_id`` and ``query`` (array of structs) as annotated XML."""
    annotated.write.format("xml").option("rootTag", "webscope").option("rowTag", "session").save(path)


def write_corrections(corrections: DataFrame, path: str) -> None:
    """The map of links to canonical ones, kept for a later run."""
    corrections.select("link", "canonical").write.mode("overwrite").parquet(path)
