"""Property lookup in a small knowledge base, disambiguation by context, and dictionary upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def break_words(tokens: DataFrame, properties: DataFrame) -> DataFrame:
    """The first token that names a property: longer than three letters, one a prefix of the other, lengths within two.

    ``tokens`` has ``query_id``, ``i``, ``token``.  The list of properties is small and fixed.
    """
    fits = (F.length("token") > 3) & (F.abs(F.length("token") - F.length("break_word")) <= 2) & (F.startswith("token", "break_word") | F.startswith("break_word", "token"))
    hits = tokens.join(F.broadcast(properties), fits)
    return hits.groupBy("query_id").agg(F.min_by(F.struct("i", "token", "break_word"), F.struct("i", "ord")).alias("b")).select("query_id", "b.i", "b.token", "b.break_word")


def kb_lookup(found: DataFrame, subjects: DataFrame, properties: DataFrame, claims: DataFrame) -> DataFrame:
    """Values of a subject for every property that owns the break word; items with underscores, times as they are."""
    named = found.join(subjects, "query_id").join(F.broadcast(properties.select("break_word", F.col("pid").alias("property")).distinct()), "break_word")
    got = named.join(claims.where(F.col("datatype").isin("item", "wikibase-item", "time")), ["subject", "property"])
    value = F.when(F.col("datatype") == "time", F.col("object")).otherwise(F.replace("object", F.lit(" "), F.lit("_")))
    return got.select("query_id", "subject", "property", value.alias("value"))


def disambiguate(options: DataFrame) -> DataFrame:
    """Greatest rank on the summary, then on the content where no summary fits; ambiguous options are out.

    ``options``: ``query_id``, ``page_id``, ``title``, ``is_ambiguous``, ``summary_rank``, ``content_rank``.
    """
    clear = options.where("NOT is_ambiguous")
    first = lambda c: F.max_by("title", F.when(F.col(c) > 0, F.struct(F.col(c), -F.col("page_id"))))
    got = clear.groupBy("query_id").agg(first("summary_rank").alias("s"), first("content_rank").alias("c"), F.max("summary_rank").alias("sm"), F.max("content_rank").alias("cm"))
    return got.where("sm > 0 OR cm > 0").select("query_id", F.when(F.col("sm") > 0, F.col("s")).otherwise(F.col("c")).alias("title"))


def refresh(dictionary: DataFrame, titles: DataFrame, redirects: DataFrame, cap: int = 1001) -> DataFrame:
    """First ``cap`` candidates of a surface whose link is a title; redirected ones renamed: ``status`` tells."""
    t = titles.select("title", "page_id").groupBy("title").agg(F.min("page_id").alias("page_id"))
    first = dictionary.where(F.col("rank") <= cap)
    got = first.join(t, first.link == t.title, "left").join(redirects, F.col("page_id") == F.col("rd_from"), "left")
    status = F.when(F.col("page_id").isNull(), "missing").when(F.col("rd_title").isNotNull(), "redirected").otherwise("unchanged")
    return got.select("surface", "rank", F.coalesce("rd_title", "link").alias("link"), "prob", status.alias("status"))


def canonical(links: DataFrame, corrections: DataFrame) -> DataFrame:
    """Adds ``canonical``: a known correction (of the name without ``_(disambiguation)``), else the link."""
    bare = F.replace("link", F.lit("_(disambiguation)"), F.lit(""))
    got = links.withColumn("__bare", bare).join(corrections.select(F.col("link").alias("__bare"), F.col("canonical").alias("__to")), "__bare", "left")
    return got.withColumn("canonical", T.unquote(F.coalesce("__to", "link"))).drop("__bare", "__to")


def validate(mentions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Mentions or gold spans with their links made canonical."""
    return canonical(mentions, corrections).withColumn("link", F.col("canonical")).drop("canonical")


def build_dictionary(lines: DataFrame, block_lines: int = 1 << 16) -> DataFrame:
    """Dictionary from TSV lines (``line_no``, ``surface``, ``value`` = prior, link, rest ignored) as the loader reads them.

    Runs of equal surfaces are lists; the last run of the file is never stored; of several runs of
    a surface the first counts.  Lines without a second field are skipped.  File order is the rank.
    Runs are told apart inside blocks of lines, in parallel; only one row a block is put in order
    as a whole, to carry the surface and the run that a block begins with.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.col("value").isNotNull()).select("line_no", F.floor(F.col("line_no") / block_lines).alias("block"), "surface", parts[0].cast("double").alias("prob"), F.get(parts, 1).alias("link"))
    rows = rows.where("link IS NOT NULL")
    w = Window.partitionBy("block").orderBy("line_no")
    over = Window.orderBy("block")
    ends = rows.groupBy("block").agg(F.max_by("surface", "line_no").alias("end")).withColumn("before", F.lag("end").over(over)).drop("end")
    new = F.coalesce(F.coalesce(F.lag("surface").over(w), F.col("before")) != F.col("surface"), F.lit(True))
    rows = rows.join(F.broadcast(ends), "block").withColumn("start", F.when(new, F.col("line_no")))
    carried = rows.groupBy("block").agg(F.max("start").alias("top")).withColumn("carried", F.max("top").over(over.rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    rows = rows.join(F.broadcast(carried), "block").withColumn("run", F.coalesce(F.max("start").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried")))
    last = rows.agg(F.max("run").alias("last"))
    kept = rows.join(F.broadcast(last)).where(F.col("run") < F.col("last"))
    first = kept.groupBy("surface").agg(F.min("run").alias("run"))
    rank = F.row_number().over(Window.partitionBy("surface").orderBy("line_no"))
    return kept.join(first, ["surface", "run"]).select("surface", rank.alias("rank"), "link", "prob")
