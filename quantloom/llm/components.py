"""Connected components of an edge list, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Tables, dropped, stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b", tables: Tables | None = None) -> DataFrame:
    """node, component (its component's smallest node) for every node of an edge.

    Each step is a grouped minimum and a join on the node; the shared folder holds the state, so a
    lost executor costs one step; tables: where the last one is noted. Ends when a round changes nothing (a number of rounds logarithmic
    in the longest chain). Loops (a = b), repeated and null edges are ignored.
    """
    at = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    before = _state(at)
    if not before[0]:
        return at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, at = at, stored(small, "small_star")
        dropped(old, large)
        now = _state(at)
        if now == before:
            if tables:
                tables.made.append(at)
            return at.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
