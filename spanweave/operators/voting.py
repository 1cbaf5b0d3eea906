"""Collective voting, coherence pruning, the session-aware dynamic program and arbitration.

What a voter says about a link depends on its surface alone, so votes are computed once for
each (surface, link) and not for each pair of mentions: a mention's total is the query's sum
for the link less its own share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import sent, stage

LIMIT, TAU, EPSILON, THETA = 50, 0.005, 0.1, 0.3
DP_LIMIT, DP_THETA, SIGMA, BOOST, ZERO = 8, 0.25, 1.0, 2.0, 0.00001


def limit(dictionary: DataFrame, k: int = LIMIT, tau: float | None = None) -> DataFrame:
    """Candidates of prior ``tau`` or more (none asked if falsy), the first ``k`` of them in list order."""
    some = dictionary.where(F.col("prob") >= tau) if tau else dictionary
    return some.withColumn("r", F.row_number().over(Window.partitionBy("surface").orderBy("rank"))).where(F.col("r") <= k).drop("r")


def surface_votes(cands: DataFrame, rel: DataFrame) -> DataFrame:
    """Sum of prior times relatedness over a surface's candidates, by the number whose relatedness is known."""
    got = cands.join(rel.select(F.col("e1").alias("target"), F.col("e2").alias("link"), "rel"), "link").groupBy("surface", "target")
    return got.agg((F.sum(F.col("prob") * F.col("rel")) / F.count("rel")).alias("vote"))


def votes(mentions: DataFrame, cands: DataFrame, rel: DataFrame, whole: bool = False) -> DataFrame:
    """``query_id``, ``ord`` and ``votes`` (``rank``, ``link``, ``prob``, ``vote`` of every candidate) of every mention, demoted ones too.

    What surfaces say is stored first, so that its size is known and a small one is sent to the mentions, not they to it.
    Mentions are stored in buckets of queries; a query's sums, the map of them and its mentions
    then meet without a shuffle, and a mention stays one row.  ``whole``: all columns of mentions, and those without candidates too.
    """
    each = stage(surface_votes(cands, rel), "surface-votes")
    said = stage(each.groupBy("surface").agg(F.collect_list(F.struct("target", "vote")).alias("said")), "said")
    own = cands.join(each.withColumnRenamed("target", "link"), ["surface", "link"], "left").select("surface", "rank", "link", "prob", F.coalesce("vote", F.lit(0.0)).alias("own"))
    lists = stage(own.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("rank", "link", "prob", "own"))).alias("cands")), "vote-lists")
    own_columns = mentions.columns if whole else ["query_id", "ord"]
    rows = mentions if whole else mentions.select("query_id", "ord", "surface")
    sums = rows.join(said, "surface").select("query_id", F.inline("said")).groupBy("query_id", "target").agg(F.sum("vote").alias("sum"))
    sums = sums.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "sum"))).alias("sums"))
    total = lambda c: F.coalesce(F.try_element_at("sums", c["link"]), F.lit(0.0))
    vote = lambda c: F.round(F.greatest(total(c) - c["own"], F.lit(0.0)), 9)
    made = F.transform("cands", lambda c: F.struct(c["rank"].alias("rank"), c["link"].alias("link"), c["prob"].alias("prob"), vote(c).alias("vote")))
    return rows.join(lists, "surface", "left" if whole else "inner").join(sums, "query_id", "left").select(*own_columns, made.alias("votes"))


def _choice(of: Column, none: Column) -> Column:
    """Place in the list of the greatest prior, the first of equals."""
    best = F.array_max(F.transform(of, lambda c: F.struct(c["prob"].alias("p"), (-c["rank"]).alias("r"))))
    return (F.coalesce(-best["r"], none) - 1).cast("int").alias("chosen")


def choose_epsilon(voted: DataFrame, epsilon: float | None = None, *more: str, old: Column | None = None) -> DataFrame:
    """Among votes of ``epsilon`` or more the greatest prior, the first of equals; none: the first candidate, and without candidates the ``old`` choice."""
    fit = F.filter("votes", lambda c: (c["vote"] >= (epsilon or EPSILON)) & (c["prob"] > 0))
    none = F.try_element_at("votes", F.lit(1))["rank"]
    return voted.select("query_id", "ord", *more, _choice(fit, none if old is None else F.coalesce(none, old + 1)))


def choose_topk(voted: DataFrame, part_limit: int = 10, digits: int = 9) -> DataFrame:
    """Among the ``part_limit`` greatest votes, to ``digits`` places (earlier candidates first of equals) the greatest prior."""
    order = F.transform("votes", lambda c: F.struct((-F.round(c["vote"], digits)).alias("v"), c["rank"].alias("rank"), c["prob"].alias("prob")))
    return voted.select("query_id", "ord", _choice(F.slice(F.array_sort(order), 1, part_limit), F.lit(None)))


def with_choice(mentions: DataFrame, chosen: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions with a new choice (kept where none is given) and its ``link`` and ``prob``; -1 has neither."""
    new = mentions.drop("link", "prob").withColumnRenamed("chosen", "old").join(chosen, ["query_id", "ord"], "left")
    return with_link(new.withColumn("chosen", F.coalesce("chosen", "old").cast("int")).drop("old"), dictionary)


def with_link(new: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``link`` and ``prob`` of the chosen candidates; -1 has neither."""
    pick = dictionary.select("surface", (F.col("rank") - 1).alias("chosen"), "link", "prob")
    return new.join(pick, ["surface", "chosen"], "left")


def coherence(chosen: DataFrame, rel: DataFrame) -> DataFrame:
    """Mean relatedness to the query's other choices (missing: 0) plus half the prior; a lone choice has 1."""
    act = chosen.where("chosen >= 0").groupBy("query_id").agg(F.collect_list(F.struct("ord", "link", "prob")).alias("all"))
    each = act.select("query_id", "all", F.size("all").alias("n"), F.inline("all"))
    pairs = each.select("query_id", "ord", "link", "prob", "n", F.explode("all").alias("o")).select("query_id", "ord", "link", "prob", "n", F.when(F.col("o.ord") != F.col("ord"), F.col("o.link")).alias("l2"))
    pairs = pairs.join(rel.select(F.col("e1").alias("link"), F.col("e2").alias("l2"), "rel"), ["link", "l2"], "left")
    got = pairs.groupBy("query_id", "ord", "link", "prob", "n").agg(F.sum("rel").alias("s"))
    coh = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.coalesce("s", F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)) + F.col("prob") / 2)
    return got.select("query_id", "ord", "link", F.round(coh, 9).alias("coherence"), "n")


def prune(chosen: DataFrame, rel: DataFrame, theta: float | None = None, compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """Unset incoherent choices; also total coherence of each query (sum kept, by the number chosen).

    ``compat``: the i-th of the chosen mentions that fails unsets the i-th of all mentions.
    """
    coh = stage(coherence(chosen, rel), "coherence", "query_id").withColumn("keep", F.col("coherence") > (theta or THETA))
    total = coh.groupBy("query_id").agg((F.sum(F.when(F.col("keep"), F.col("coherence")).otherwise(0.0)) / F.count("*")).alias("total"), F.count("*").alias("n_chosen"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ord")) if compat else F.col("ord")
    gone = coh.withColumn("at", place).where("NOT keep").select("query_id", F.col("at").alias("ord"), F.lit(True).alias("gone"))
    out = chosen.join(gone, ["query_id", "ord"], "left")
    unset = lambda c, v: F.when(F.col("gone"), v).otherwise(F.col(c)).alias(c)
    keep = [c for c in chosen.columns if c not in ("chosen", "link", "prob")]
    return out.select(*keep, unset("chosen", F.lit(-1)), unset("link", F.lit(None)), unset("prob", F.lit(None))), total


def first_seen(mentions: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id``, ``link``, ``since``: the first query of a session whose segmentation chose the link."""
    act = mentions.where("chosen = 0").join(sessions, "query_id")
    return act.groupBy("session_id", F.col("link0").alias("link")).agg(F.min("query_ord").alias("since"))


def session_history(mentions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Links of this and earlier queries of the session, sorted."""
    seen = first_seen(mentions, sessions).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("link", "since"))).alias("seen"))
    rows = sessions.join(seen, "session_id", "left")
    links = F.transform(F.filter("seen", lambda s: s["since"] <= F.col("query_ord")), lambda s: s["link"])
    return rows.select("query_id", "session_id", "query_ord", F.coalesce(links, F.array().cast("array<string>")).alias("history"))


def dp_choice(mentions: DataFrame, dictionary: DataFrame, rel: DataFrame, sessions: DataFrame, k: int = DP_LIMIT, compat: bool = True) -> DataFrame:
    """Chain program over a query's mentions in list order; ``compat`` leaves the first of several as it was.

    Scores against the previous mention's candidates depend on the two surfaces only, so the
    matrices are made once for each pair of surfaces that stand side by side, stored, and sent to the
    mentions if small, so that mentions with their candidates stay where they are.  What a session has
    chosen goes to each of its queries as a list of links, joined once a query.
    """
    cands = limit(dictionary, k)
    lists = sent(stage(cands.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("rank", "link", "prob"))).alias("cands")), "dp-lists"))
    by = Window.partitionBy("query_id").orderBy("ord")
    rows = mentions.select("query_id", "ord", "surface").withColumn("before", F.lag("surface").over(by))
    pairs = rows.where("before IS NOT NULL").select("before", "surface").distinct()
    one = pairs.join(cands.select("surface", F.col("rank").alias("r"), F.col("link").alias("l")), "surface").join(cands.select(F.col("surface").alias("before"), F.col("rank").alias("pr"), F.col("link").alias("pl")), "before")
    one = one.join(rel.select(F.col("e1").alias("l"), F.col("e2").alias("pl"), "rel"), ["l", "pl"], "left")
    line = one.groupBy("before", "surface", "r").agg(F.sort_array(F.collect_list(F.struct("pr", F.coalesce("rel", F.lit(0.0)).alias("v")))).alias("row"))
    matrix = line.groupBy("before", "surface").agg(F.sort_array(F.collect_list(F.struct("r", F.col("row.v").alias("v")))).alias("rows")).select("before", "surface", F.col("rows.v").alias("matrix"))
    matrix = sent(stage(matrix, "dp-matrix"))
    one = F.struct("ord", "cands", F.coalesce("matrix", F.array().cast("array<array<double>>")).alias("matrix"))
    listed = rows.join(lists, "surface").join(matrix, ["before", "surface"], "left").groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("ms"))
    history = stage(session_history(mentions, sessions).select("query_id", "history"), "history", "query_id")
    had = lambda c: F.array_contains("history", c["link"])
    base = lambda m: F.transform(m["cands"], lambda c: c["prob"] * F.when(had(c), F.lit(BOOST)).otherwise(F.lit(1.0)))
    ms = listed.join(history, "query_id").select("query_id", F.transform("ms", lambda m: F.struct(m["ord"].alias("ord"), base(m).alias("base"), m["matrix"].alias("matrix"))).alias("ms"))
    state = "array<struct<v:double,path:array<int>>>"
    start = F.transform(F.element_at("ms", 1)["base"], lambda b, i: F.struct(b.alias("v"), F.array(i).alias("path"))).cast(state)

    def step(acc: Column, m: Column) -> Column:
        def cell(b: Column, e: Column) -> Column:
            scores = F.zip_with(acc, F.get(m["matrix"], e), lambda s, r: F.round(s["v"] * b * r * SIGMA, 15))
            let = F.transform(F.array(scores), lambda x: F.struct(F.array_max(x).alias("top"), F.array_position(x, F.array_max(x)).cast("int").alias("at")))
            made = F.transform(let, lambda x: F.struct(F.when(x["top"] > 0, x["top"]).otherwise(F.lit(ZERO)).alias("v"), F.array_append(F.get(acc, F.when(x["top"] > 0, x["at"] - 1).otherwise(F.lit(0)))["path"], e).alias("path")))
            return F.element_at(made, 1)

        return F.transform(m["base"], cell).cast(state)

    done = ms.select("query_id", F.transform("ms", lambda m: m["ord"]).alias("ords"), F.aggregate(F.slice("ms", 2, F.size("ms")), start, step).alias("end"))
    top = F.array_max(F.transform("end", lambda s: s["v"]))
    best = F.when(top > 0, F.element_at(F.filter("end", lambda s: s["v"] == top), 1)).otherwise(F.element_at("end", -1))
    out = done.select("query_id", F.size("ords").alias("m"), F.posexplode(F.arrays_zip("ords", best["path"].alias("path"))).alias("i", "x"))
    if compat:
        out = out.where((F.col("i") > 0) | (F.col("m") == 1))
    return out.select("query_id", F.col("x.ords").alias("ord"), F.col("x.path").alias("chosen"))


def confidence(queries: DataFrame, pruned: DataFrame, total: DataFrame, factor: float = 1.3, divisor: float = 2.3) -> DataFrame:
    """Coherence times 1.3 plus the share of tokens that chose, divided by 2.3."""
    n = pruned.groupBy("query_id").agg(F.count_if(F.col("chosen") >= 0).alias("active"))
    got = queries.select("query_id", F.size("tokens").alias("tokens")).join(n, "query_id").join(total, "query_id", "left")
    share = F.try_divide(F.col("active").cast("double"), F.col("tokens"))
    return got.select("query_id", F.round(F.coalesce("total", F.lit(0.0)) * factor + share / divisor, 6).alias("confidence"))


def arbitrate(first: DataFrame, second: DataFrame) -> DataFrame:
    """``query_id``, ``winner``: the greater confidence; the first of equals."""
    both = first.join(second.withColumnRenamed("confidence", "other"), "query_id")
    return both.select("query_id", F.when(F.col("confidence") >= F.col("other"), "voting").otherwise("dynamic").alias("winner"))
