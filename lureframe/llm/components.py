"""Connected components of a link table by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) of every node that has a link to another.

    Each round points the larger neighbours of a node at its smallest one, then the smaller ones; a handful of rounds
    suffice even for long chains.  Smallest neighbours are found by combined minima and joined back, never gathered in
    lists, so a node with a third of all links is spread like any other rows.  Every round is written out.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least(u, m).alias("m"))
        large = stored(both.join(least, "u").where(v > u).select(v.alias("u"), m.alias("v")).distinct(), "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != m).select(v.alias("u"), m.alias("v"))
        edges = stored(small.unionByName(least.select("u", m.alias("v"))).distinct(), "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            return edges.select(u.alias("node"), v.alias("root"))
        before = now
