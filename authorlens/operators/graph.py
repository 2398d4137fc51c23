"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from authorlens.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable, for every node with an edge.

    ``edges`` has columns (a, b) of one orderable type; direction, repeats and loops do not
    matter.  Each round joins the edges with one row per node, so a node with very many
    edges is split by adaptive skew joins, and its neighbours are reduced by partial
    aggregates.  The rounds are logarithmic in the longest path; each cuts its lineage.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = cut_lineage(e), None
    while True:
        # large star: every larger neighbour of u, and u's edges, go to the least of u and its neighbours
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u and u itself go to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        e = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .union(small.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
