"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.sources.shared import Tables, dropped, shared_path, stored

__all__ = ["Tables", "WORD", "dropped", "order_buckets", "placed", "read", "running_totals", "shared_path", "stored", "summed_before", "unit"]

#: Words of a text: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unit(*cols: Column | str, seed: int) -> Column:
    """A reproducible number in [0, 1) from the columns and the seed."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def running_totals(df: DataFrame, value: str, out: str, order: list[Column], group: list[str] | None = None, bucket: Column | None = None, buckets: int = 1024) -> DataFrame:
    """Adds out = sum of value over the rows before this one, within group, in the order of (bucket, order).

    One group may hold any share of the rows: rows are summed inside (group, bucket) and only the
    buckets' totals (at most `buckets` rows a group) are summed across. bucket must be an integer
    column of at most `buckets` values; by default a hash of nothing but the order columns' row, so
    that the order is reproducible but not by the order columns alone.
    """
    group = group or []
    b, fine = "_bucket", Window.partitionBy(*group, "_bucket")
    df = df.withColumn(b, bucket if bucket is not None else F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = fine.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, b).agg(F.sum(value).alias("_total"))
    across = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g).alias(f"_k{i}") for i, g in enumerate(group)]
    starts = totals.select(*keys, F.col(b).alias("_b"), F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_start"))
    same = F.col(b) == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    summed = df.withColumn("_in", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return summed.join(starts, same, "left").withColumn(out, F.col("_start") + F.col("_in")).drop(b, "_b", "_start", "_in", *[f"_k{i}" for i in range(len(group))])


def _ranged(df: DataFrame, group: list[str], order: list[str], tables: Tables) -> DataFrame:
    """df, read from a stored table, with _row (in the order of group and order) and _part (the range it is in); stored.

    Rows are sorted in ranges of (group, order, place in df), so that neither a group nor equal rows have to fit one task.
    """
    keys = [*group, *order, "_tie"]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    return tables.stored(ranged.withColumn("_row", F.monotonically_increasing_id()), "ranged").withColumn("_part", F.shiftright("_row", 33))


def _with_starts(at: DataFrame, group: list[str], tables: Tables, n: Column, *more: Column) -> DataFrame:
    """at with _start: the sum of n over the group's earlier ranges; and more aggregates of the group's part of the range."""
    names = [f"_g{i}" for i, _ in enumerate(group)]
    spans = at.groupBy(*[F.col(g).alias(k) for g, k in zip(group, names, strict=True)], F.col("_part").alias("_p")).agg(n.alias("_n"), *more)
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = tables.stored(spans.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "ranges")
    same = F.col("_part") == F.col("_p")
    for g, k in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(k))
    return at.join(starts, same)


def placed(df: DataFrame, group: list[str], order: list[str], out: str, tables: Tables) -> DataFrame:
    """df, read from a stored table, with out: each row's number, from 0, in its group by the order (nulls first).

    Neither a group nor equal rows have to fit one task; what a range of rows starts with in each group comes from a
    small table of the ranges' counts.
    """
    at = _with_starts(_ranged(df, group, order, tables), group, tables, F.count("*"), F.min("_row").alias("_first"))
    return at.select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_start")).alias(out))


def summed_before(df: DataFrame, value: str, group: list[str], order: list[str], out: str, tables: Tables) -> DataFrame:
    """df, read from a stored table, with out: the sum of value over the rows before, in the group by the order (nulls first); spread as by placed()."""
    at = _with_starts(_ranged(df, group, order, tables), group, tables, F.sum(value))
    inside = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return at.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).select(*df.columns, (F.col("_start") + F.col("_in")).alias(out))


#: Low bits of a bucket's number that part rows of one key (or of none) by their tie's hash.
TIES = 16


def order_buckets(df: DataFrame, key: str, tie: Column, rows: int = 1000, quantiles: int = 64, most: int = 1 << 20) -> Column:
    """A column of range buckets of an integer key: the larger the key, the larger the bucket (null: negative).

    About `rows` rows a bucket, at most `most` ranges: quantiles of the key, each cut into equal widths, so
    that ids may lie in clusters. Rows without a key, and those of a key that fills quantiles by itself, are
    parted further by `tie`, a hash by which such rows are ordered (as a signed number). Two small aggregates
    of the key are read for it.
    """
    wanted = [k / quantiles for k in range(1, quantiles)]
    r = df.agg(F.count("*").alias("all"), F.count(key).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.percentile_approx(key, F.array(*[F.lit(w) for w in wanted]), F.lit(2000)).alias("q")).first()

    def part(n: int) -> Column:
        count = max(1, min(1 << TIES - 1, -(-n // rows)))
        return F.least(F.floor((tie.cast("double") / F.lit(2.0**64) + 0.5) * count), F.lit(count - 1)).cast("long")

    missing = F.lit(-1 << TIES).cast("long") + part(r["all"] - r.n)
    if not r.n:
        return missing
    points, ranges = [int(x) for x in r.q], min(quantiles, -(-r.n // rows))
    cuts = {points[quantiles * k // ranges - 1] for k in range(1, ranges)}
    hot = {x: points.count(x) for x in set(points) if points.count(x) > 1}
    cuts |= {x + k for x in hot for k in (0, 1)}  # a range of its own
    bounds = [r.low, *sorted(x for x in cuts if r.low < x <= r.high), r.high + 1]
    each = max(1, min(most, -(-r.n // rows)) // (len(bounds) - 1))
    k = F.col(key)
    width = [max(1, -(-(b - a) // each)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    inner = F.array(*[F.lit(b).cast("long") for b in bounds[1:-1]]) if len(bounds) > 2 else F.array().cast("array<bigint>")
    which = F.size(F.filter(inner, lambda b: b <= k))
    start, wide = (F.element_at(F.array(*[F.lit(v).cast("long") for v in x]), which + 1) for x in (bounds[:-1], width))
    coarse = which.cast("long") * each + F.least(F.floor((k - start) / wide), F.lit(each - 1))
    ties = F.lit(0).cast("long")
    for x, times in sorted(hot.items()):
        ties = F.when(k == x, part((times + 1) * r.n // quantiles)).otherwise(ties)
    return F.when(k.isNull(), missing).otherwise(coarse * F.lit(1 << TIES) + ties)
