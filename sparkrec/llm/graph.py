"""Connected components by alternating star contraction (large star, small star).

Every round is joins and partial aggregates over the edge table; no node's
neighbours are collected. Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrec.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> ``(u, root)`` for every node with a link, root included.

    The root is the smallest node reachable. Self links, repeated links and
    links with a null end are ignored; an empty table gives an empty result.
    """
    edges = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct())
    return edges.select("u", F.col("v").alias("root")).union(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
