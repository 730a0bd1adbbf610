"""Writing results: factor values partitioned by month, summaries, and lists of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_frame(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """As csv if the path ends so, else as parquet; values with a dt column are partitioned by month."""
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    elif "dt" in df.columns:
        df.withColumn("month", F.trunc("dt", "month")).write.mode(mode).partitionBy("month").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def save_names(df: DataFrame, path: str, column: str = "name", mode: str = "errorifexists") -> None:
    """One name a line, in order."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode(mode).text(path)
