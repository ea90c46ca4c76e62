"""Connected components by contraction.

Each round, every node points to its smallest neighbour if that is smaller, pointers are followed once more, and edges
are drawn between what the pointers reach. Nodes at least halve, so rounds grow with the logarithm of the nodes.
Tables are written between rounds; joins read both sides from files, so Spark can split the large partitions of hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); the component is its smallest node."""
    edges = edges.where(F.col("a") != F.col("b"))
    labels = None
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("to")))
        step = cut(ends.groupBy("node").agg(F.min("to").alias("to")), "step")
        after = step.select(F.col("node").alias("to"), F.col("to").alias("then"))
        jump = cut(step.join(after, "to").select("node", F.col("then").alias("to")), "jump")
        if labels is None:
            labels = jump.select("node", F.col("to").alias("component"))
        else:
            moved = labels.join(jump.select(F.col("node").alias("component"), "to"), "component", "left")
            labels = cut(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        first = edges.join(jump.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        both = cut(first, "half").join(jump.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select("x", "y")
        edges = cut(both.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
