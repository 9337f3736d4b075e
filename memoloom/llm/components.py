"""Connected components of a graph given as edges, by alternating star contractions.

Every round is two joins on keys and is written to the shared folder, so a lost executor costs one round at most. Nodes
with very many edges are split by adaptive skew joins; nothing is gathered per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoloom.workspace import materialized


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """On edges that point from the larger node a to the smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("root"))
    moved = edges.join(least, "a").where("b > root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.union(least.select("a", F.col("root").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); the component is its smallest node. Loops are ignored."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialized(edges, "links")
    state = _state(edges)
    while state[0]:
        edges = materialized(_small_star(_large_star(edges)), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
