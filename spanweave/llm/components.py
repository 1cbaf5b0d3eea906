"""Connected components by contraction, in the cluster.

Each round points every node at its smallest neighbour, follows the pointers to their ends
by doubling, and replaces the nodes of all edges by them.  Edges inside a group vanish; the
graph shrinks by a constant factor or more, so the rounds grow with the logarithm of its
size.  All aggregates are minima (summed on the map side), all tables are stored in the
shared folder, and nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, discard


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of the edges ``a``, ``b``; null ends are skipped."""
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = None
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), name)
        while True:
            on = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = cut(up.join(on, "up", "left").select("node", F.coalesce("upper", "up").alias("up"), (F.col("upper") < F.col("up")).alias("moved")), name)
            more = not jumped.where("moved").isEmpty()
            discard(up)
            up = jumped
            if not more:
                break
        to = lambda x: up.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up"))
        left = live.join(to("a"), "a").join(to("b"), "b").where("a_up <> b_up")
        left = cut(left.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), name)
        if labels is None:
            new = cut(up.select("node", F.col("up").alias("component")), name)
        else:
            new = cut(labels.join(up.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")), name)
            discard(labels)
        for old in (live, up):
            discard(old)
        live, labels = left, new
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
