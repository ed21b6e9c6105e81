"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two groupings of the remaining links; the number of rounds grows with the
logarithm of the number of nodes. Lineage is cut with checkpoints in the shared folder, so a
lost executor repeats one round at most, and nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node (the larger ones, or the smaller ones) to the smallest of node and neighbours."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = both.join(least, "u")
    if large:
        return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); component: the smallest node reachable."""
    current = cut_lineage(links.select("u", "v").filter("u <> v").distinct())
    for _ in range(rounds):
        nxt = cut_lineage(_star(_star(current, True), False))
        changed = nxt.exceptAll(current).limit(1).count() or current.exceptAll(nxt).limit(1).count()
        current = nxt
        if not changed:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    raise RuntimeError("the components didn't settle")
