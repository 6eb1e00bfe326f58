"""Connected components of an edge table with large-star / small-star rounds (MapReduce form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of its component) for every node of edges (a, b).

    Each round links every node to the least of its neighbours, first for larger, then for
    smaller neighbours; rounds grow with the logarithm of a component's size. A node's
    minimum is aggregated before it is joined back, so no neighbour list is held.
    Empty edges give an empty table; self links and repeated links are harmless.
    """
    now = blocks.checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
        # a node with very many neighbours does not gather them in one task: keyed() tells such nodes by their uses
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("uses"))
        large = blocks.keyed(both.filter("v > u"), least, "u", "uses", state.n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("uses"))
        small = blocks.keyed(large, low, "u", "uses", state.n).select(F.col("v").alias("w"), "m").unionByName(low.select(F.col("u").alias("w"), "m"))
        now = blocks.checkpoint(small.filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct())
    lows = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(lows)
