"""Queries that write and read back: the stream of daily bars, sinks, small csv inputs, registered factors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.catalog.registry import built_in
from quantloom.functions import expr as X
from quantloom.plans.panel_queries import shown
from quantloom.plans.stages import rounding, to_sql
from quantloom.sources.dimensions import scan_benchmark
from quantloom.sources.panel import MONTH_SQL, grid, grid_sql, panel_month
from quantloom.sources.shared import shared_path
from quantloom.sources.sinks import save_frame, save_names
from quantloom.streaming.readout import keep_parts, merged_bars, run_available

Query = Callable[[SparkSession, str], DataFrame]


def intraday_readout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's bars of all days but those that the watermark has not passed."""
    # the times have no zone; a watermark needs instants
    utc = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("instrument"), utc.alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"))
    source, target = shared_path(spark, "ticks"), shared_path(spark, "bars")
    ticks.write.parquet(source)
    run_available(spark, source, target, shared_path(spark, "stream_state"))
    return shown(spark.read.parquet(target))


STREAM_SQL = f"""WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), b AS (SELECT user_id AS instrument, CAST(ts AS DATE) AS dt, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(value) AS volume, sum(value) AS amount FROM events GROUP BY 1, 2)
SELECT instrument, dt, volume, {", ".join(f"{rounding(x)} AS {x}" for x in ("open", "high", "low", "close", "amount"))} FROM b, m WHERE dt + INTERVAL 1 DAY <= mark"""


def intraday_readout_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all days from a stream that runs twice: even events first, then the odd ones, of which many are late."""
    utc = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("instrument"), utc.alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"))
    source, target, state = shared_path(spark, "ticks"), shared_path(spark, "bars"), shared_path(spark, "stream_state")
    for half in (0, 1):
        ticks.where(F.col("id") % 2 == half).coalesce(1).write.mode("append").parquet(source)
        keep_parts(spark, source, target, state)
    bars = merged_bars(spark.read.parquet(f"{target}/parts"))
    return shown(bars)


REVISED_SQL = f"""WITH m AS (SELECT max(ts) FILTER (WHERE event_id % 2 = 0) - INTERVAL 1 DAY AS early, max(ts) - INTERVAL 1 DAY AS mark FROM events),
b AS (SELECT user_id AS instrument, CAST(ts AS DATE) AS dt, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(value) AS volume, sum(value) AS amount,
  count(CASE WHEN event_id % 2 = 1 AND CAST(ts AS DATE) + INTERVAL 1 DAY <= early THEN 1 END) AS n_late FROM events, m GROUP BY 1, 2)
SELECT instrument, dt, volume, n_late, dt + INTERVAL 1 DAY <= mark AS closed, {", ".join(f"{rounding(x)} AS {x}" for x in ("open", "high", "low", "close", "amount"))} FROM b, m"""


def registry_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors that the registry finds by source and prefix, computed on the month panel."""
    r = built_in()
    names = r.find(source="alpha158", prefix="alpha158.K")
    return shown(r.compute(grid(spark, sf_dir), names).withColumnsRenamed({n: n.partition(".")[2] for n in names}))


def _found() -> dict[str, X.Expr]:
    """The bar factors of the 158 set, typed apart from the catalog."""
    o, h, low, c = (X.field(n) for n in ("open", "high", "low", "close"))
    span, top, bottom = h - low + 1e-12, X.greater(o, c), X.less(o, c)
    made = {"KMID": X.div(c - o, o), "KLEN": X.div(h - low, o), "KMID2": X.div(c - o, span), "KUP": X.div(h - top, o), "KUP2": X.div(h - top, span), "KLOW": X.div(bottom - low, o), "KLOW2": X.div(bottom - low, span), "KSFT": X.div(2 * c - h - low, o), "KSFT2": X.div(2 * c - h - low, span)}
    return made


def sink_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "values")
    save_frame(panel_month(spark, sf_dir).select("dt", "instrument", "close"), path)
    return shown(spark.read.parquet(path).where("month >= DATE '1996-01-01'").select("dt", "instrument", "close"))


def sink_factor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "names")
    save_names(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name")).distinct(), path)
    return spark.read.text(path).select(F.col("value").alias("name"))


def scan_benchmark_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "benchmark") + ".csv"
    save_frame(panel_month(spark, sf_dir).groupBy(F.col("dt").cast("string").alias("date")).agg(F.avg("open").alias("open"), F.avg("close").alias("close")), path)
    return shown(scan_benchmark(spark, path))


def compute_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's column function and a user's tree, registered beside the catalogs."""
    r = built_in()
    r.register("user_body", lambda df: F.try_divide(F.col("close") - F.col("open"), F.col("open")), required_fields=("open", "close"))
    r.register("user_trend", X.div(X.field("close"), X.ts_mean(X.field("close"), 6)))
    r.register("user_bar", r.trees["alpha158.KLEN"])
    return shown(r.compute(grid(spark, sf_dir), ["user_body", "user_trend", "user_bar"]))


_TREES = {"user_trend": X.div(X.field("close"), X.ts_mean(X.field("close"), 6)), "user_bar": X.div(X.field("high") - X.field("low"), X.field("open")), "user_body": X.div(X.field("close") - X.field("open"), X.field("open"))}

QUERIES: dict[str, tuple[Query, str | None]] = {
    "intraday_readout_stream": (intraday_readout_stream, STREAM_SQL),
    "intraday_readout_revised": (intraday_readout_revised, REVISED_SQL),
    "registry_find": (registry_find, to_sql(grid_sql(), _found())),
    "sink_frame": (sink_frame, f"SELECT dt, instrument, {rounding('close')} AS close FROM ({MONTH_SQL}) WHERE dt >= DATE '1996-01-01'"),
    "sink_factor_list": (sink_factor_list, "SELECT DISTINCT 'f' || p_partkey AS name FROM part"),
    "scan_benchmark": (
        scan_benchmark_csv,
        f"SELECT dt, {', '.join(f'{rounding(x)} AS {x}' for x in ('benchmark_open', 'benchmark_close', 'market_return'))} FROM (SELECT dt, benchmark_open, benchmark_close, benchmark_close / nullif(lag(benchmark_close) OVER (ORDER BY dt), 0) - 1 AS market_return FROM (SELECT dt, avg(open) AS benchmark_open, avg(close) AS benchmark_close FROM ({MONTH_SQL}) GROUP BY dt))",
    ),
    "register_compute_factor": (compute_factor, to_sql(grid_sql(), _TREES)),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
