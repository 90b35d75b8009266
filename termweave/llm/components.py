"""Connected components of an edge table by alternating large and small stars, with every round written to the shared
folder. Degrees are reduced by minima before anything is joined, so a node with very many edges is no hot group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm._spark import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours go to its smallest one; small: so do the smaller ones and itself."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        kept = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        kept = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return kept.where("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, and none of these has one."""
    up = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").select(F.col("v").alias("u"))
    return up.unionAll(chained).isEmpty()


def components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node that it reaches."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", made)
    while not _done(now):
        now = written(_star(_star(now, True), False), "stars", made)
    # all edges now lead from a node to its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
