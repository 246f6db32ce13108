"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Shelf


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) edges: component is the smallest node reachable.

    Each round stores the edges; rounds grow with the logarithm of the longest path. Only minima are aggregated per node,
    so a node with many edges is combined before the shuffle, and the joins back can be split where a key is skewed.
    """
    shelf = Shelf()
    now = shelf.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lower.select("u", F.col("m").alias("v"))
        ).distinct()
        last, now = now, shelf.keep(small)
        shelf.drop(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none: then these are the components."""
    down = edges.groupBy("u").agg(F.count("*").alias("n"))
    if down.where("n > 1").limit(1).count():
        return False
    return not edges.select(F.col("v").alias("u")).join(down, "u", "left_semi").limit(1).count()
