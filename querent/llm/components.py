"""Connected components of a graph in a table of edges, by large and small stars.

Each step sends every node's smallest neighbour to its other neighbours; edges end as
stars around the smallest node of each component. Steps are joins and minimum aggregates
with map-side combination, so a node with many neighbours is never gathered. Lineage is
cut after every round by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import probed


def _large(edges: DataFrame) -> DataFrame:
    """For each node, its larger neighbours point to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """For each node, its smaller neighbours and itself point to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (u, v); component is the least node. Nodes of any comparable type; loops and repeats do no harm."""
    state = [F.bit_xor(F.xxhash64("u", "v"))]
    now, seen = probed(edges.select("u", "v").where("u <> v").distinct(), state)
    while True:
        now, after = probed(_small(_large(now)), state)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
