"""Small inputs from csv: benchmark series and industry codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SERIES = ("open", "close", "high", "low", "volume", "amount")


def scan_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """dt, benchmark_* of the columns that exist, market_return; what is no number is missing."""
    raw = spark.read.option("header", True).csv(path)
    if "date" not in raw.columns:
        raise ValueError("a benchmark file needs the column date")
    kept = raw.select(F.to_date("date").alias("dt"), *[F.col(c).try_cast("double").alias(f"benchmark_{c}") for c in SERIES if c in raw.columns])
    # a row a day: one small partition
    previous = F.lag("benchmark_close").over(Window.orderBy("dt"))
    return kept.withColumn("market_return", F.try_divide("benchmark_close", previous) - 1) if "benchmark_close" in kept.columns else kept


def scan_industry(spark: SparkSession, path: str) -> DataFrame:
    """instrument (NNNNNN.XX), industry: blank industries are dropped, the last row of an instrument in file order wins."""
    raw = spark.read.option("header", True).csv(path).withColumn("_line", F.monotonically_increasing_id())
    digits, market = F.regexp_extract("code", r"(\d{6})", 1), F.upper(F.regexp_extract("code", r"([A-Za-z]{2})", 1))
    named = raw.select(F.concat_ws(".", digits, market).alias("instrument"), F.trim("industry").alias("industry"), "_line").where("industry IS NOT NULL AND industry <> '' AND instrument RLIKE '^[0-9]{6}'")
    return named.groupBy("instrument").agg(F.max_by("industry", "_line").alias("industry"))


def levels(df: DataFrame, code: str = "industry") -> DataFrame:
    """sector (a letter), industry (a letter and two digits) and subindustry (the whole code)."""
    c = F.col(code)
    return df.select("instrument", F.substring(c, 1, 1).alias("sector"), F.substring(c, 1, 3).alias("industry"), c.alias("subindustry"))
