"""Ranks of a column within groups of any size, by ranges of values instead of one sort a group.

Distinct values are counted first, so ties are one row however many they are. Each group's values are cut at
approximate quantiles into ranges; counts of ranges give each range's start, and only values of one range
are sorted together. Ranks are exact: the cuts decide where work is done, not its result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges that a group's values are cut into.
RANGES = 64


def near(x: Column) -> Column:
    """A value to 33 binary digits, whatever its size, so that noise in the last ones makes no order."""
    wide = x * F.lit(1048577.0)
    return F.when(F.abs(x) < 1e300, wide - (wide - x)).otherwise(x)


def ranged(df: DataFrame, value: Column, by: Sequence[str] = ("dt",), ranges: int = RANGES, base: DataFrame | None = None) -> DataFrame:
    """df with _below (rows of the group with a smaller value), _ties (with the same, itself included) and _present (with any); null where the value is.

    Null groups are groups; rows without a value are counted nowhere. base: the same rows, to count from, where df already
    has joins that need not be made again for that.
    """
    keys = [f"_g{i}" for i, _ in enumerate(by)]
    named = df.withColumn("_v", value)
    counts = (named if base is None else base.withColumn("_v", value)).where(F.col("_v").isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "_v").agg(F.count("*").alias("_ties"))
    shares = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    cuts = counts.groupBy(*[F.col(k).alias(f"c{k}") for k in keys]).agg(F.percentile_approx("_v", shares, F.lit(1000)).alias("_cuts"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"c{k}"))
    placed = counts.join(cuts, same).select(*keys, "_v", "_ties", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))
    sums = placed.groupBy(*[F.col(k).alias(f"s{k}") for k in keys], F.col("_range").alias("s_range")).agg(F.sum("_ties").alias("_n"))
    group = Window.partitionBy(*[f"s{k}" for k in keys])
    before = group.orderBy("s_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(group).alias("_present"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("s_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"s{k}"))
    below = placed.withColumn("_in", F.coalesce(F.sum("_ties").over(inside), F.lit(0))).join(starts, same).select(*keys, F.col("_v").alias("_w"), "_ties", "_present", (F.col("_start") + F.col("_in")).alias("_below"))
    same = F.col("_v") == F.col("_w")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return named.join(below, same, "left").drop("_v", "_w", *keys)


def cs_ranked(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = ("dt",), ranges: int = RANGES) -> DataFrame:
    """df with each named column: the least rank among ties over the number present."""
    base = df
    for name, value in columns.items():
        df = ranged(df, value, by, ranges, base).withColumn(name, (F.col("_below") + 1) / F.col("_present")).drop("_below", "_ties", "_present")
    return df


def average_ranked(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = ("dt",), ranges: int = RANGES) -> DataFrame:
    """df with each named column: the rank, ties averaged."""
    base = df
    for name, value in columns.items():
        df = ranged(df, value, by, ranges, base).withColumn(name, F.col("_below") + (F.col("_ties") + 1) / 2).drop("_below", "_ties", "_present")
    return df
