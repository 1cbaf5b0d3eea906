"""Links of sets that share a bucket, exactly and without squaring any bucket.

1. Every member of a bucket is paired with the bucket's head: the member that shares most
   buckets with others (in a group of copies that is the original, if it is there).  Pairs
   are confirmed on the full sets; links give components.
2. Members of one head whose components still differ may be linked with each other.  For a
   head c write D(x) for the symmetric difference of x and c.  Jaccard similarity t or more
   of x and y means |x - y| + |y - x| <= k (|x| + |y|) with k = (1 - t) / (1 + t).  If y is
   not linked with c then |D(y)| > k (|y| + |c|), and it follows that D(x) and D(y) share at
   least (1 - k) |D(x)| / 2 elements; if x is the unlinked one, at least
   |D(x)| - (1 - t) / t |x|; and one in any case.  So, with the elements of every D in order
   of their frequency under the head, the pair meets in prefixes of length |D| - bound + 1.
   Joining the prefixes finds every link that is missing; elements that occur once meet
   nobody, and the first common element of a link leaves enough places behind it on both
   sides for the overlap that the sizes ask for.  What copies have in common with the original is in no D, so a large group of
   edited copies meets only where the same edits were made.
3. These pairs are confirmed too, and components are made once more.

Nothing is capped: the result is that of comparing all pairs that share a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, discard


def confirm(pairs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets have a Jaccard similarity of ``limit`` percent or more."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", (F.size("s_a") + F.size("s_b")).alias("n"), F.size(F.array_intersect("s_a", "s_b")).alias("i"))
    return both.where(100 * F.col("i") >= limit * (F.col("n") - F.col("i"))).select("a", "b")


def _stars(bands: DataFrame, name: str) -> DataFrame:
    sizes = cut(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), name + "-sizes")
    members = cut(bands.join(sizes, "key"), name + "-members")
    fame = cut(members.groupBy("node").agg(F.sum("size").alias("fame")), name + "-fame")
    known = cut(members.select("key", "node").join(fame, "node"), name + "-known")
    most = known.groupBy("key").agg(F.max("fame").alias("fame"))
    heads = cut(known.join(cut(most, name + "-most"), ["key", "fame"]).groupBy("key").agg(F.min("node").alias("head")), name + "-heads")
    stars = known.join(heads, "key").where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = cut(stars, name + "-stars")
    for old in (sizes, members, fame, known, heads):
        discard(old)
    return stars


def _missing(stars: DataFrame, links: DataFrame, labels: DataFrame, sets: DataFrame, limit: int, name: str) -> DataFrame:
    """Pairs under one head, of different components, that may be links."""
    t = limit / 100
    k = (1 - t) / (1 + t)
    named = stars.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c0")), "b", "left").select("a", "b", F.coalesce("c0", "b").alias("c"))
    named = cut(named, name + "-component")
    mixed = cut(named.groupBy("a").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("a"), name + "-mixed")
    open_ = named.join(mixed, "a").join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    open_ = open_.join(side("a"), "a").join(side("b"), "b")
    apart = F.concat(F.array_except("s_a", "s_b"), F.array_except("s_b", "s_a"))
    open_ = open_.select("a", "b", "c", F.coalesce("linked", F.lit(False)).alias("linked"), F.size("s_b").alias("n"), apart.alias("d"))
    d = F.size("d")
    shared = d * ((1 - k) / 2)
    bound = F.when(F.col("linked"), shared).otherwise(F.least(shared, d - F.col("n") * ((1 - t) / t)))
    prefix = (d - F.greatest(F.ceil(bound - 1e-6), F.lit(1)) + 1).cast("int")
    rows = cut(open_.select("a", "b", "c", "n", d.alias("size"), prefix.alias("prefix"), F.explode("d").alias("e")), name + "-apart")
    often = cut(rows.groupBy("a", "e").agg(F.count("*").alias("often")).where("often > 1"), name + "-often")
    by = Window.partitionBy("a", "b")
    met = rows.join(often, ["a", "e"]).withColumn("m", F.count("*").over(by)).withColumn("r", F.row_number().over(by.orderBy("often", "e")))
    met = met.withColumn("place", F.col("size") - F.col("m") + F.col("r")).where("place <= prefix")
    met = cut(met.select("a", "e", "b", "c", "n", "size", "place"), name + "-prefixes")
    x, y = met.alias("x"), met.alias("y")
    on = (F.col("x.a") == F.col("y.a")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.c") < F.col("y.c"))
    left = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    on &= left >= (F.col("x.size") + F.col("y.size") - k * (F.col("x.n") + F.col("y.n"))) / 2 - 1e-6
    pairs = x.join(y, on).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
    pairs = cut(pairs, name + "-pairs")
    for old in (named, rows, often, met):
        discard(old)
    return pairs


def link(bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], limit: int, likely: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, name: str = "link") -> DataFrame:
    """``node`` and ``component`` of all nodes with a link.

    ``bands`` has ``key`` and ``node``; ``sets_of`` takes a frame of nodes and gives ``node`` and
    ``shingles``; ``likely`` drops pairs that cannot be links.
    """
    stars = _stars(bands, name)
    nodes = cut(stars.select("a").union(stars.select("b")).distinct().select(F.col("a").alias("node")), name + "-nodes")
    sets = cut(sets_of(nodes), name + "-sets")
    links = cut(confirm(likely(stars), sets, limit), name + "-links")
    labels = components(links, name)
    pairs = _missing(stars, links, labels, sets, limit, name)
    if not pairs.isEmpty():
        more = cut(confirm(likely(pairs), sets, limit), name + "-more")
        if not more.isEmpty():
            labels = components(links.union(more), name)
    for old in (stars, nodes, sets):
        discard(old)
    return labels
