"""Connected components by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabary.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root``: the smallest node reachable from each node of ``a, b`` that has a smaller one.

    Each turn hangs the larger neighbours of every node on its smallest (large star), then the smaller ones (small star); the
    turns end when all edges point at roots. Nodes without a smaller reachable node are left out; the result is a written table.
    """
    at, mark, turn = scratch.keep(_tidy(edges), f"{name}-0"), None, 0
    while True:
        turn += 1
        both = at.union(at.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("c")).select(F.col("m").alias("a"), "b")
        large = _tidy(large)
        lowest = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("c"), "m")
        small = large.join(lowest, F.col("b") == F.col("c")).select("m", F.explode(F.array("a", "b")).alias("v"))
        now = scratch.keep(_tidy(small.select(F.col("m").alias("a"), F.col("v").alias("b"))), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        # Equal sums, without overflow, of two 64-bit hashes of every edge: the edges are those of the turn before.
        seen = now.agg(F.count("*"), *[F.sum(F.xxhash64(*x).cast("decimal(20,0)")) for x in (("a", "b"), ("b", "a", F.lit(1)))]).first()
        if seen == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        at, mark = now, seen


def _tidy(edges: DataFrame) -> DataFrame:
    """Distinct edges with a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
