"""N-grams of a query, dictionary lookup and overlap resolution."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.stage import stage


def ngrams(queries: DataFrame, max_n: int | Column | None = None) -> DataFrame:
    """All runs of tokens, longest first and from the left: ``query_id``, ``position``, ``word_count``, ``surface``.

    Lengths and places are exploded one after the other, so that surfaces are made in generated code.
    """
    w = F.col("tokens")
    top = F.size(w) if max_n is None else F.least(F.size(w), max_n if isinstance(max_n, Column) else F.lit(max_n))
    each = queries.where(top > 0).select("query_id", "tokens", F.explode(F.sequence(top, F.lit(1), F.lit(-1))).alias("word_count"))
    each = each.select("query_id", "tokens", "word_count", F.explode(F.sequence(F.lit(0), F.size(w) - F.col("word_count"))).alias("position"))
    return each.select("query_id", "position", "word_count", F.array_join(F.slice(w, F.col("position") + 1, F.col("word_count")), " ").alias("surface"))


def nested(dictionary: DataFrame) -> DataFrame:
    """One row a surface: candidates in rank order."""
    got = dictionary.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("rank", "link", "prob"))).alias("cands"))
    return got


def lookup(grams: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Equi join on the surface, case-sensitive; adds the first candidate's link and prior and the number of candidates."""
    top = dictionary.groupBy("surface").agg(F.min_by("link", "rank").alias("link0"), F.min_by("prob", "rank").alias("p0"), F.count("*").cast("int").alias("n_cands"))
    return grams.join(top, "surface").select("query_id", "position", "word_count", "surface", "link0", "p0", "n_cands")


def lookup_cascade(grams: DataFrame, dictionary: DataFrame, variants: list[tuple[str, Column]]) -> DataFrame:
    """As ``lookup``, by the first hit among the term and its ``variants`` in turn; ``matched`` and ``turn`` (0: the term itself) tell which.

    Forms are made once for each distinct term, not for each of its places; they cost much for their bytes, so terms are dealt to all tasks.
    """
    forms = F.array(*(F.struct(F.lit(i).alias("turn"), f.alias("form")) for i, (_, f) in enumerate([("exact", F.col("surface")), *variants])))
    terms = grams.select("surface").distinct().repartition(int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")), "surface")
    tried = terms.select("surface", F.inline(forms))
    top = dictionary.groupBy("surface").agg(F.min_by("link", "rank").alias("link0"), F.min_by("prob", "rank").alias("p0"), F.count("*").cast("int").alias("n_cands"))
    hit = tried.join(top.withColumnRenamed("surface", "form"), "form")
    first = hit.groupBy("surface").agg(F.min_by(F.struct(F.col("form").alias("matched"), "link0", "p0", "n_cands", "turn"), "turn").alias("x")).select("surface", "x.*")
    first = stage(first, "cascade-forms")
    return grams.join(first, "surface").select("query_id", "position", "word_count", "surface", "matched", "turn", "link0", "p0", "n_cands")


_KEPT = "array<struct<pos:int,n:int,p:double,surface:string,link0:string>>"


def _crosses(m: Column, c: Column) -> Column:
    """An end or the start of ``c`` lies strictly inside ``m``."""
    inside = lambda x: (m["pos"] < x) & (x < m["pos"] + m["n"])
    return inside(c["pos"]) | inside(c["pos"] + c["n"])


def overlap_lists(candidates: DataFrame) -> DataFrame:
    """Greedy choice, longest first: a shorter crossing mention goes, one as long with a smaller prior too.

    Otherwise the earlier one of equal length is demoted (``chosen`` -1) but stays and blocks.
    A query's candidates are folded in one row, and its mentions stay one list ``ms``; ``ord`` is the place in it, from 1.
    """
    one = F.struct((-F.col("word_count")).alias("k"), F.col("position").alias("pos"), F.col("word_count").alias("n"), F.col("p0").alias("p"), "surface", "link0")
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("cs"))

    def step(kept: Column, c: Column) -> Column:
        beaten = F.exists(kept, lambda m: _crosses(m, c) & ((c["n"] < m["n"]) | (c["p"] < m["p"])))
        return F.when(beaten, kept).otherwise(F.array_append(kept, F.struct(c["pos"], c["n"], c["p"], c["surface"], c["link0"]))).cast(_KEPT)

    kept = lists.select("query_id", F.aggregate("cs", F.array().cast(_KEPT), step).alias("kept"))

    def named(m: Column, i: Column) -> Column:
        later = F.exists(F.slice("kept", i + 2, F.size("kept")), lambda b: (b["n"] == m["n"]) & (b["pos"] < m["pos"] + m["n"]))
        return F.struct(
            (i + 1).alias("ord"), m["pos"].alias("position"), m["n"].alias("word_count"), m["surface"].alias("surface"),
            m["link0"].alias("link0"), m["p"].alias("p0"), F.when(later, -1).otherwise(0).alias("chosen"),
        )

    return kept.select("query_id", F.transform("kept", named).alias("ms"))


def resolve_overlaps(candidates: DataFrame) -> DataFrame:
    """``overlap_lists``, one row a mention."""
    return overlap_lists(candidates).select("query_id", F.inline("ms"))


def fewest_candidates(candidates: DataFrame) -> DataFrame:
    """The other comparator: of two crossing mentions the one with fewer candidates stays; equals keep the earlier."""
    one = F.struct((-F.col("word_count")).alias("k"), F.col("position").alias("pos"), F.col("word_count").alias("n"), F.col("n_cands").alias("c"), "surface")
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("cs"))
    kind = "array<struct<pos:int,n:int,c:int,surface:string>>"

    def step(kept: Column, c: Column) -> Column:
        hit = F.exists(kept, lambda m: _crosses(m, c) & (m["c"] <= c["c"]))
        rest = F.filter(kept, lambda m: ~_crosses(m, c))
        return F.when(hit, kept).otherwise(F.array_append(rest, F.struct(c["pos"], c["n"], c["c"], c["surface"]))).cast(kind)

    return lists.select("query_id", F.inline(F.aggregate("cs", F.array().cast(kind), step))).toDF("query_id", "position", "word_count", "n_cands", "surface")


def clean(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each mention with one candidate left: the chosen one, or the last of the list where none is; ``chosen`` is 0 or stays -1."""
    cands = dictionary.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("rank", "link", "prob"))).alias("cands"))
    one = F.element_at("cands", F.when(F.col("chosen") >= 0, F.col("chosen") + 1).otherwise(-1).cast("int"))
    rows = mentions.select("query_id", "ord", "surface", "chosen").join(cands, "surface").select("query_id", "ord", "surface", "chosen", one.alias("c"))
    return rows.select("query_id", "ord", "surface", F.least("chosen", F.lit(0)).alias("chosen"), "c.link", "c.prob")


def with_gold(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """Queries that have a gold mention."""
    return queries.join(gold.select("query_id").distinct(), "query_id", "left_semi")


def from_annotator(queries: DataFrame, annotations: DataFrame, compat: bool = True) -> DataFrame:
    """Mentions from a stored annotator's answers (``query_id``, ``start`` in characters, ``surface``, ``link``, ``prob``); ``compat`` puts all at the last token."""
    rows = annotations.join(queries.select("query_id", "text"), "query_id")
    ord_ = F.row_number().over(Window.partitionBy("query_id").orderBy("start", "surface", "link"))
    words = F.size(T.split_words(F.col("surface")))
    return rows.select("query_id", ord_.alias("ord"), T.token_at(F.col("text"), F.col("start"), compat).alias("position"), words.alias("word_count"), "surface", F.lit(0).alias("chosen"), "link", "prob")


def first_crossing(mentions: DataFrame) -> DataFrame:
    """For each mention the least ``ord`` of the earlier ones it crosses, or null."""
    by = mentions.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("position").alias("pos"), F.col("word_count").alias("n")))).alias("ms"))
    each = by.select("query_id", "ms", F.inline("ms"))
    earlier = F.filter("ms", lambda m: (m["ord"] < F.col("ord")) & _crosses(m, F.struct(F.col("pos").alias("pos"), F.col("n").alias("n"))))
    return each.select("query_id", "ord", F.try_element_at(F.transform(earlier, lambda m: m["ord"]), F.lit(1)).alias("crosses"))


def stopwords(tokens: Column, words: tuple[str, ...] = ("o", "r"), compat: bool = True) -> Column:
    """Drop stop words.  ``compat``: after each removal the next token is passed over, as by deleting while iterating."""
    stop = lambda t: t.isin(*words)
    if not compat:
        return F.filter(tokens, lambda t: ~stop(t))
    state = "struct<out:array<string>,skip:boolean>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip")).cast(state)
    keep = lambda s, t: s["skip"] | ~stop(t)
    step = lambda s, t: F.struct(F.when(keep(s, t), F.array_append(s["out"], t)).otherwise(s["out"]).alias("out"), (~keep(s, t)).alias("skip")).cast(state)
    return F.aggregate(tokens, start, step, lambda s: s["out"])


def query_diff(queries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Words of a query that the session's previous query lacks, in order, repeats kept."""
    w = Window.partitionBy("session_id").orderBy("query_ord")
    rows = queries.join(sessions, "query_id").withColumn("prev", F.lag("tokens").over(w))
    new = F.when(F.col("prev").isNull(), F.array().cast("array<string>")).otherwise(F.filter("tokens", lambda t: ~F.array_contains("prev", t)))
    return rows.select("query_id", "session_id", "query_ord", new.alias("new_words"))


_LOW_BITS = 12


def _parts(queries: DataFrame, bits: Column) -> DataFrame:
    """Each query once for every number ``high`` that its ``bits`` less the ``_LOW_BITS`` last can hold, dealt over all tasks.

    So no row holds an array of all 2^bits choices, and those of one long query are made in many tasks.
    """
    last = F.pow(F.lit(2), F.greatest(bits - _LOW_BITS, F.lit(0))).cast("bigint") - 1
    parts = queries.where(F.size("tokens") > 0).select("query_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("high"))
    return parts.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, list[str], int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("query_id")[i], batch.column("tokens")[i].as_py(), batch.column("high")[i].as_py()


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of ``high`` are the first gaps; the others double the strings."""
    for query, words, high in _rows(batches):
        fixed = max(0, len(words) - 1 - _LOW_BITS)
        head = words[0] + "".join(" |"[high >> i & 1] + words[i + 1] for i in range(fixed))
        made = pa.array([head])
        for w in words[fixed + 1 :]:
            made = pa.concat_arrays([pc.binary_join_element_wise(made, w, gap) for gap in " |"])
        yield pa.RecordBatch.from_arrays([pa.repeat(query, len(made)), made], ["query_id", "cut"])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of ``high`` are the first words; the others double the strings.  Each word brings the blank before it."""
    for query, words, high in _rows(batches):
        fixed = max(0, len(words) - _LOW_BITS)
        made = pa.array(["".join(" " + words[i] for i in range(fixed) if high >> i & 1)])
        for w in words[fixed:]:
            made = pa.concat_arrays([made, pc.binary_join_element_wise(made, w, " ")])
        made = (made if high else made[1:]).value_counts()
        text = pc.utf8_slice_codeunits(made.field("values"), 1)
        yield pa.RecordBatch.from_arrays([pa.repeat(query, len(text)), text, made.field("counts")], ["query_id", "words", "n"])


def segmentation_rows(queries: DataFrame) -> DataFrame:
    """All 2^(n-1) ways to cut a query of n tokens: ``query_id``, ``cut``."""
    return _parts(queries, F.size("tokens") - 1).mapInArrow(_cuts, "query_id bigint, cut string")


def subset_rows(queries: DataFrame) -> DataFrame:
    """All 2^n - 1 non-empty choices of a query's n tokens, equal ones counted: ``query_id``, ``words``, ``n``."""
    return _parts(queries, F.size("tokens")).mapInArrow(_choices, "query_id bigint, words string, n bigint").groupBy("query_id", "words").agg(F.sum("n").alias("n"))
