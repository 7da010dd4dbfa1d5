"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _least(edges: DataFrame) -> DataFrame:
    """(u, least): the smallest of each node and its neighbours v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of ``links`` (u, v) that isn't the smallest of
    its component, ``root``.  Links may repeat, go either way or be loops;
    rows with a null end are ignored.  Rounds grow with the logarithm of the
    longest path; no step holds a component in one task."""
    edges = (links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    edges = materialize(edges, "links")
    before = _mark(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select("u", F.col("v").alias("root"))
