"""Connected components of large sparse graphs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.session import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over distinct edges (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(least, "a")
    moved = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether all edges are stars: each node has one edge down, and none leads to a node with another."""
    several = edges.groupBy("a").agg(F.count("*").alias("c")).filter("c > 1").select("a")
    return several.unionByName(edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")).isEmpty()


def components(edges: DataFrame, tasks: int = 0) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable.

    edges has columns a and b; direction, repeats and loops do not matter. Each round is kept in the
    shared folder, in that many files at most if tasks is given; the rounds grow with the logarithm of
    the longest path.
    """
    now = edges.filter("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges", tasks)
    while not _done(now):
        before, now = now, materialize(_star(_star(now, True), False), "edges", tasks)
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
