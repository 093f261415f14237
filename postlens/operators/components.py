"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.workspace import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (a > b) are stars around their least nodes: a node has one edge down, and the other end has none."""
    down = edges.groupBy("a").agg(F.count("*").alias("n"))
    inner = edges.select(F.col("b").alias("a")).distinct().join(down, "a", "left_semi")
    return down.where("n > 1").select("a").unionByName(inner).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Gives node, root for every node of an edge between two nodes; root is the component's least node.

    Minima are pre-aggregated and joined back, so no neighbourhood is ever gathered in one task.
    Each round is staged, and none follows once all edges are stars; the rounds are logarithmic in the size of the largest component.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while not _stars(now):
        now = stage(_small_star(stage(_large_star(now), "stars")), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
