"""Panels of (dt, instrument) rows: scans, fixtures from order lines, and the dense grid."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.sources.shared import stored

PRICES = ("open", "high", "low", "close")
#: Dates in a list (a daily panel has some 250 a year).
LIST = 10_000


def scan_panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None, start: date | str | None = None, end: date | str | None = None, instruments: Sequence | None = None) -> DataFrame:
    """Rows of a parquet panel keyed (dt, instrument): those of the listed columns that exist, in an inclusive range of dates."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select("dt", "instrument", *[c for c in columns if c in df.columns and c not in ("dt", "instrument")])
    if start is not None:
        df = df.where(F.col("dt") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("dt") <= F.lit(end).cast("date"))
    if instruments is not None:
        df = df.where(F.col("instrument").isin(list(instruments)))
    return df


def _bars(lines: DataFrame, instrument: Column, period: str, order: list[str]) -> DataFrame:
    """A bar's lines are brought together as narrow rows, then aggregated: partial bars hold two keys each, and few lines of one bar lie together before."""
    px = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    columns = dict.fromkeys([*order, "l_extendedprice", "l_quantity"])
    dealt = lines.select(instrument.alias("instrument"), F.date_trunc(period, "l_shipdate").cast("date").alias("dt"), *columns).repartition("dt", "instrument")
    rows = dealt.select("instrument", "dt", px.alias("px"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amt"), F.struct(*order).alias("key"))
    return rows.groupBy("dt", "instrument").agg(
        F.min_by("px", "key").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "key").alias("close"),
        F.sum("qty").alias("volume"),
        F.sum("amt").alias("amount"),
        F.try_divide(F.sum("amt"), F.sum("qty")).alias("vwap"),
    )


def panel_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of suppliers, made of order lines in one aggregation."""
    bars = _bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_suppkey"), "month", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return bars.select(
        "*",
        (F.col("volume") / (F.lit(1000.0) + F.col("instrument")) * 100.0).alias("turnover"),
        F.when(F.col("instrument") % 17 == 0, 1).otherwise(0).alias("is_st"),
        F.when(F.col("volume") > 0, 1).otherwise(0).alias("trade_status"),
    )


def panel_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of nations; suppliers are a small dimension."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    joined = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return _bars(joined, F.col("s_nationkey"), "week", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def densify(panel: DataFrame) -> DataFrame:
    """The dense grid: every instrument on every date, absent cells null.

    Dates stand in lists of at most LIST each; every instrument is exploded to the lists' numbers, then to their dates,
    and the panel is joined by key.
    """
    dates = panel.select("dt").distinct().withColumn("_list", F.floor((F.row_number().over(Window.orderBy("dt")) - 1) / LIST).cast("int"))
    lists = dates.groupBy("_list").agg(F.sort_array(F.collect_list("dt")).alias("_dates"))
    last = dates.agg(F.max("_list")).scalar()
    asked = panel.select("instrument").distinct().where(last.isNotNull()).select("instrument", F.explode(F.sequence(F.lit(0), last)).alias("_of"))
    grid = asked.join(lists, F.col("_of") == F.col("_list")).select("instrument", F.explode("_dates").alias("dt"))
    return grid.join(panel, ["instrument", "dt"], "left")


def undensify(grid: DataFrame, column: str) -> DataFrame:
    """Back to the cells that have a value."""
    return grid.where(F.col(column).isNotNull())


#: The panels in SQL that DuckDB runs; first and last price by all key columns, since line keys repeat.
MONTH_SQL = """
WITH t AS (
  SELECT l.l_suppkey AS instrument, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS dt,
         l.l_extendedprice / NULLIF(l.l_quantity, 0) AS px, l.l_quantity AS qty, l.l_extendedprice AS amt,
         row_number() OVER (PARTITION BY l.l_suppkey, date_trunc('month', l.l_shipdate)
           ORDER BY l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice) AS rn,
         count(*) OVER (PARTITION BY l.l_suppkey, date_trunc('month', l.l_shipdate)) AS n
  FROM lineitem l)
SELECT dt, instrument,
       max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
       max(CASE WHEN rn = n THEN px END) AS close,
       sum(qty) AS volume, sum(amt) AS amount, sum(amt) / NULLIF(sum(qty), 0) AS vwap,
       sum(qty) / (1000.0 + instrument) * 100.0 AS turnover,
       CASE WHEN instrument % 17 = 0 THEN 1 ELSE 0 END AS is_st,
       CASE WHEN sum(qty) > 0 THEN 1 ELSE 0 END AS trade_status
FROM t GROUP BY dt, instrument
"""
WEEK_SQL = """
WITH t AS (
  SELECT s.s_nationkey AS instrument, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS dt,
         l.l_extendedprice / NULLIF(l.l_quantity, 0) AS px, l.l_quantity AS qty, l.l_extendedprice AS amt,
         row_number() OVER (PARTITION BY s.s_nationkey, date_trunc('week', l.l_shipdate)
           ORDER BY l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS rn,
         count(*) OVER (PARTITION BY s.s_nationkey, date_trunc('week', l.l_shipdate)) AS n
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)
SELECT dt, instrument,
       max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
       max(CASE WHEN rn = n THEN px END) AS close,
       sum(qty) AS volume, sum(amt) AS amount, sum(amt) / NULLIF(sum(qty), 0) AS vwap
FROM t GROUP BY dt, instrument
"""


def with_groups(spark: SparkSession, sf_dir: str, panel: DataFrame, kind: str) -> DataFrame:
    """sector, industry and subindustry of each instrument (region and nation), joined as a small dimension."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    if kind == "month":
        dim = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("instrument"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))
    else:
        dim = nation.select(F.col("n_nationkey").alias("instrument"), F.col("r_name").alias("sector"), F.col("r_name").alias("industry"))
    return panel.join(dim.withColumn("subindustry", F.col("industry")), "instrument", "left")


def with_market(grid: DataFrame, panel: DataFrame) -> DataFrame:
    """The benchmark's open and close (means of the panel's rows on the date) on every row of the grid."""
    by_date = panel.groupBy("dt").agg(F.avg("open").alias("benchmark_open"), F.avg("close").alias("benchmark_close"))
    return grid.join(by_date, "dt", "left")


def grid(spark: SparkSession, sf_dir: str, kind: str = "month", mark: str | None = None) -> DataFrame:
    """A dense panel with every field that factors use; mark names a column that is true where the panel has a row.

    The bars are stored once; dates, instruments, cells and the benchmark are all read from there.
    """
    panel = stored((panel_month if kind == "month" else panel_week)(spark, sf_dir), "panel")
    cells = densify(panel.withColumn(mark, F.lit(True)) if mark else panel)
    return with_market(with_groups(spark, sf_dir, cells, kind), panel)


def grid_sql(kind: str = "month") -> str:
    source = MONTH_SQL if kind == "month" else WEEK_SQL
    extra = ", p.turnover, p.is_st, p.trade_status" if kind == "month" else ""
    dim = (
        "SELECT s_suppkey AS instrument, r_name AS sector, n_name AS industry, n_name AS subindustry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
        if kind == "month"
        else "SELECT n_nationkey AS instrument, r_name AS sector, r_name AS industry, r_name AS subindustry FROM nation JOIN region ON n_regionkey = r_regionkey"
    )
    return f"""SELECT d.dt, i.instrument, p.open, p.high, p.low, p.close, p.volume, p.amount, p.vwap{extra},
  g.sector, g.industry, g.subindustry, avg(p.open) OVER (PARTITION BY d.dt) AS benchmark_open, avg(p.close) OVER (PARTITION BY d.dt) AS benchmark_close
FROM (SELECT DISTINCT dt FROM ({source})) d CROSS JOIN (SELECT DISTINCT instrument FROM ({source})) i
LEFT JOIN ({source}) p ON p.dt = d.dt AND p.instrument = i.instrument LEFT JOIN ({dim}) g ON g.instrument = i.instrument"""
