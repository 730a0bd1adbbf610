"""Daily bars from a stream of ticks: tumbling windows with a watermark, or mergeable parts that late ticks revise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def readout_stream(ticks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Bars of each instrument and day, emitted when the watermark has passed the day; later rows are dropped.

    ticks: a streaming frame with instrument, ts, id, price.
    """
    key = F.struct("ts", "id")
    bars = (
        ticks.withWatermark("ts", lateness)
        .groupBy("instrument", F.window("ts", "1 day").alias("w"))
        .agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count("price").alias("volume"), F.sum("price").alias("amount"))
    )
    day = F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int"))  # of UTC, as the windows are
    return bars.select("instrument", day.alias("dt"), "open", "high", "low", "close", "volume", "amount")


def run_available(spark: SparkSession, source: str, target: str, checkpoint: str, lateness: str = "1 day") -> None:
    """Reads all tick files that are there, writes finished bars as parquet and returns."""
    schema = spark.read.parquet(source).schema
    ticks = spark.readStream.schema(schema).parquet(source)
    writing = readout_stream(ticks, lateness).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    writing.awaitTermination()


# --- bars that late ticks revise -------------------------------------------------------------------------------


def parts(ticks: DataFrame, mark: Column | None = None) -> DataFrame:
    """Mergeable parts of bars, a row an (instrument, day): first and last tick, extremes, counts and sum, the newest time.

    n_late: ticks of days that had ended when `mark`, the time up to which ticks were complete, had been reached.
    """
    tick = F.struct("ts", "id", "price")
    day = F.to_date("ts")
    late = F.lit(False) if mark is None else F.coalesce(F.date_add(day, 1).cast("timestamp") <= mark, F.lit(False))
    return ticks.groupBy("instrument", day.alias("dt")).agg(F.min(tick).alias("first"), F.max(tick).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("price").alias("volume"), F.sum("price").alias("amount"), F.count_if(late).alias("n_late"), F.max("ts").alias("newest"))


def keep_parts(spark: SparkSession, source: str, target: str, checkpoint: str, lateness: str = "1 day") -> None:
    """Reads the tick files that have come since the last run, and writes each batch's parts of bars to target; returns when all are read.

    A batch is written to a folder of its number, so that one which is run again after a failure replaces itself.
    Late ticks are counted against the newest time of the batches before, less `lateness`, and change the bars all the same.
    """
    schema = spark.read.parquet(source).schema

    def keep(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        mark = None
        if number:
            marks = own.read.parquet(f"{target}/marks").where(F.col("batch") < number)
            newest = marks.agg((F.max("newest") - F.expr(f"INTERVAL {lateness}")).alias("m")).first().m
            mark = None if newest is None else F.lit(newest)
        parts(batch, mark).write.mode("overwrite").parquet(f"{target}/parts/batch={number}")
        done = own.read.parquet(f"{target}/parts/batch={number}").agg(F.max("newest").alias("newest"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{target}/marks/batch={number}")

    ticks = spark.readStream.schema(schema).parquet(source)
    ticks.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_bars(parts_: DataFrame, lateness: str = "1 day") -> DataFrame:
    """instrument, dt, open, high, low, close, volume, amount, n_late, closed of all days: whether no tick in time can change the bar any more."""
    bars = parts_.groupBy("instrument", "dt").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.sum("n_late").alias("n_late"))
    mark = parts_.agg(F.max("newest") - F.expr(f"INTERVAL {lateness}")).scalar()
    closed = F.date_add("dt", 1).cast("timestamp") <= mark
    return bars.select("instrument", "dt", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume", "amount", "n_late", closed.alias("closed"))
