"""Connected components by alternating large and small stars; only edges move, and each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: root is the least node that can be reached. Nodes without edges don't appear.

    The least neighbour comes from a partial aggregation and joins back, so a node with many edges is no hot task.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while (now := _state(e)) != before:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        discard(e, large)
        before, e = now, small
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The roots (node, root) once more edges (a, b) are there: only the components that an edge joins are worked on again."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    new = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    merged = new.select(F.col("node").alias("root"), F.col("root").alias("least"))
    old = roots.join(merged, "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    return old.union(new.join(roots, "node", "left_anti").select("node", "root"))
