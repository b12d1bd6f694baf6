"""Connected components by alternating large-star and small-star steps, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least).distinct()


def _print_of(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("a"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 24))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between integer nodes -> (node, root): each linked node with its component's smallest.

    Loops, repeats and either orientation are fine; null ends are dropped. A node in no link has no row.
    A hot node costs no task more than its links do: minima are pre-aggregated and joins can be split.
    """
    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b")
    now = materialize(clean.distinct(), "edges")
    seen = _print_of(now)
    while seen[0]:
        now = materialize(_small_star(_large_star(now)), "stars")
        was, seen = seen, _print_of(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
