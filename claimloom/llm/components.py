"""Connected components of an edge table by alternating large-star and small-star steps.

Everything stays in tables: neither edges nor labels are collected. Each step groups by a vertex
and takes a minimum (combined before the shuffle), then joins the minimum back; a vertex with very
many neighbours only makes one join key large, which adaptive execution splits. Each round is
written to the shared folder, so a lost executor costs one round at most; the round before is removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import discard, staged


def _star(directed: DataFrame, keep_larger_only: bool) -> DataFrame:
    """directed (u, v): link neighbours of u, and u itself, to the least of them."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = directed.join(least, "u")
    out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if keep_larger_only else linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, any direction → (v, root): root is the least vertex of v's component.

    Vertices without an edge to another vertex aren't returned; null ends, loops and repeated edges
    count for nothing.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    now, mark = staged(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        before, now = now, staged(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "edges")
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select(F.col("v"), F.col("v").alias("root")).distinct())
        mark = tuple(seen)
