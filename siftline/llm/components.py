"""Connected components of a links table by alternating stars (Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``a`` has one ``b`` and no ``b`` is an ``a`` elsewhere, so that nothing is left to do."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, component)`` of the links ``(a, b)``; a component is named by its smallest node, which has no row itself.

    Links of a node with itself or with null are ignored.  Each round is a written table, so lineage stays short.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    round_ = 0
    while not _are_stars(edges):
        round_ += 1
        edges = scratch.keep(_small_star(_large_star(edges)), f"{name}-{round_}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def joined_components(components: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``components``, as above, joined further by more ``links``; only the components' names go through the rounds."""
    named = [components.select(F.col("node").alias(x), F.col("component").alias(f"top_{x}")) for x in "ab"]
    met = links.join(named[0], "a", "left").join(named[1], "b", "left")
    tops = connected_components(met.select(F.coalesce("top_a", "a").alias("a"), F.coalesce("top_b", "b").alias("b")), scratch, f"{name}-tops")
    moved = components.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return scratch.keep(moved.select("node", F.coalesce("top", "component").alias("component")).unionByName(tops), name)
