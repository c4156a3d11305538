"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import release, stage


def _large_star(edges: DataFrame, used: list) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour. Staged tables go to `used`."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # staged, so that Spark splits a hub's rows
    used.append(least)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, used: list) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. Staged tables go to `used`."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    used.append(least)
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node without an edge to a smaller one."""
    own = edges.groupBy("a").count()
    if not own.where("count > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(own.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id, root of every node of edges (a, b): the least node it is connected with. Nodes without an edge to another aren't there.

    Each round is staged in the shared folder; the number of rounds grows with the logarithm of the
    longest path, and edges that are stars already need none.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(edges):
        used = [edges]
        edges = stage(_small_star(_large_star(edges, used), used), "edges")
        release(*used)
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots.select("id", F.col("id").alias("root")))
