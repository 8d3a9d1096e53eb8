"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from oreline.session import stage


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is named by its smallest node.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest node around it, until every component
    is a star. Rounds grow with the logarithm of the longest path. Tables of links are written to the shared folder between rounds.
    Links to null and of a node to itself are left out.
    """
    up = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    up, before = stage(up, "links"), None
    while True:
        now = tuple(up.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return up.select(F.col("u").alias("node"), F.col("v").alias("component")).union(up.select("v", "v")).distinct()
        before = now
        both = up.union(up.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        up = stage(small.select("e.*").filter("u != v").distinct(), "links")
