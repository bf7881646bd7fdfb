"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b), both bigint; root is the smallest vertex of its component.

    Each round maps every vertex to the smallest neighbour of its smallest neighbour (itself included) and carries the
    edges over to those; loops and repeated edges go. A path keeps being a path under such a map, and the smallest
    vertex stays, so what is left alone is the root. Edges fall by a large factor in each round, stars end after one.
    Rounds are written tables: a lost executor costs a re-read. Only the fact that no edge is left comes to the driver.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "near")
        # One jump on: the neighbour's own choice. Every neighbour is a vertex of `near`.
        step = near.join(near.select(F.col("a").alias("m"), F.col("m").alias("to")), "m").select(F.col("a").alias("v"), "to")
        step = written(step, "step")
        if labels is None:
            labels = step.select("v", F.col("to").alias("root"))
        else:
            on = step.select(F.col("v").alias("root"), "to")
            labels = labels.join(on, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        labels = written(labels, "labels")
        ends = step.select(F.col("v").alias("a"), F.col("to").alias("c"))
        moved = edges.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("c").alias("d")), "b")
        edges = written(moved.filter("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
