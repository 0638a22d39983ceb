"""Connected components by alternating large-star and small-star steps, each written and read again.

Edges never reach the driver, nor does a node's neighbourhood reach one task: a step is a grouped minimum
(combined map-side) and a join, which splits a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Every node points to one root, and no root points anywhere."""
    tails = edges.groupBy("u").agg(F.count("*").alias("n"))
    if not tails.where("n > 1").isEmpty():
        return False
    return edges.join(tails.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node of links that is not itself the smallest of its component."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges, "edges")
    while not _are_stars(edges):
        edges = written(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
