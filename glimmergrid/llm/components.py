"""Connected components of a graph given by its edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize


def settled(edges: DataFrame) -> bool:
    """True if every component is a star: nodes that point at one root, and roots that point nowhere."""
    marks = edges.select(F.col("a").alias("n"), F.lit(1).alias("points")).union(edges.select("b", F.lit(0)))
    nodes = marks.groupBy("n").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("edges"))
    return nodes.filter("points > 1 OR points = 1 AND edges > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it is connected to) for all nodes of ``edges`` (``a``, ``b``).

    Rounds of large and small stars: every node tells its neighbours the least
    node it knows, until each points at the least of its component. Each round
    is two grouped minima and two joins, so a node with very many neighbours is
    pre-aggregated; the minima are written before they are joined, so its rows
    can be split. Rounds grow with the logarithm of the longest path, and edges
    that are stars already need none. Every round goes to the shared folder.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not settled(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = materialize(large, "edges")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialize(small.filter("a <> b").distinct(), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
