"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternates the large-star and small-star steps until the edges are stars. Both are grouped minima
    joined back to the edges, so that a node with very many neighbours is combined before it is shuffled
    and its join can be split; each round is written to the shared folder.
    """
    e = scratch.table(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        # Large star: each node links its larger neighbours to the smallest of its neighbours and itself.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node links its smaller neighbours, and itself, to the smallest of them.
        large = scratch.table(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.table(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        scratch.drop(large)
        scratch.drop(e)
        e = new
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
