"""Panel preparation: filters with a report, and derived columns. Missing is null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.sources.panel import PRICES


def _own() -> Window:
    return Window.partitionBy("instrument").orderBy("dt")


def _date() -> Window:
    return Window.partitionBy("dt")


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; what is no finite number is missing."""

    def clean(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(c)

    return df.select(*[clean(c) if c in columns else F.col(c) for c in df.columns])


def required(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the fields it lacks."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return df


def matches(pattern: str) -> Column:
    return F.col("instrument").cast("string").rlike(pattern)


def not_special() -> Column:
    return F.coalesce(F.col("is_st"), F.lit(0)) == 0


def trading() -> Column:
    return F.coalesce(F.col("trade_status") == 1, F.lit(False))


def listed(days: int) -> Column:
    """Rows after an instrument's first `days` rows."""
    return F.row_number().over(_own()) > days


def no_limit_move(limit: float) -> Column:
    return F.coalesce(F.abs(F.col("pct_chg")) < limit, F.lit(True))


def above_quantile(value: Column, q: float) -> Column:
    """At or above the date's quantile of the value; missing fails."""
    return F.coalesce(value >= F.percentile(value, q).over(_date()), F.lit(False))


def trailing_mean(column: str, window: int = 20) -> Column:
    return F.avg(column).over(_own().rowsBetween(-(window - 1), 0))


def zero_volume_prices(df: DataFrame) -> DataFrame:
    """Prices are missing where nothing was traded."""
    return df.withColumns({c: F.when(F.coalesce(F.col("volume"), F.lit(1.0)) != 0, F.col(c)) for c in PRICES if c in df.columns})


def filtered(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """df with dropped_by: the first rule, in order, that a row fails (null: kept)."""
    flags = df.withColumns({f"_pass_{k}": rule for k, (_, rule) in enumerate(rules)})
    first = F.coalesce(*[F.when(~F.col(f"_pass_{k}"), F.lit(name)) for k, (name, _) in enumerate(rules)], F.lit(None))
    return flags.withColumn("dropped_by", first).drop(*[f"_pass_{k}" for k in range(len(rules))])


def filter_report(marked: DataFrame, rules: Sequence[str]) -> DataFrame:
    """rows_before, rows_after, instruments_after and rows dropped by each rule, in one row."""
    kept = F.col("dropped_by").isNull()
    return marked.agg(
        F.count("*").alias("rows_before"),
        F.count_if(kept).alias("rows_after"),
        F.count_distinct(F.when(kept, F.col("instrument"))).alias("instruments_after"),
        *[F.count_if(F.col("dropped_by") == r).alias(f"dropped_{r}") for r in rules],
    )


def own_returns(df: DataFrame, name: str = "returns") -> DataFrame:
    """Change of the close over the instrument's own previous row; no padding."""
    return df.withColumn(name, F.try_divide("close", F.lag("close").over(_own())) - 1)


def float_cap(df: DataFrame) -> DataFrame:
    """float_shares and float_cap: shares from volume and turnover, a 20-row median carried forward, then backward.

    The backward fill looks ahead.
    """
    rate = F.when(F.col("turnover") > 0, F.col("turnover") / 100)
    raw = df.withColumn("_raw", F.try_divide(F.abs("volume"), rate))
    raw = raw.withColumn("_median", F.percentile("_raw", 0.5).over(_own().rowsBetween(-19, 0)))
    ahead = _own().rowsBetween(0, Window.unboundedFollowing)
    filled = raw.withColumn("_past", F.last("_median", True).over(_own().rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.first("_median", True).over(ahead))
    shares = filled.withColumn("float_shares", F.coalesce("_past", "_next")).drop("_raw", "_median", "_past", "_next")
    return shares.withColumn("float_cap", F.when((F.col("close") > 0) & (F.col("float_shares") > 0), F.col("close") * F.col("float_shares")))


def cap_size(df: DataFrame) -> DataFrame:
    """cap: the float cap, else the mean amount of 252 rows (at least 21 present, 0 as missing); size: its logarithm."""
    traded = F.when(F.col("amount") != 0, F.col("amount"))
    w = _own().rowsBetween(-251, 0)
    mean = F.when(F.count(traded).over(w) >= 21, F.avg(traded).over(w))
    capped = df.withColumn("_mean", mean).withColumn("cap", F.coalesce("float_cap", "_mean")).drop("_mean")
    return capped.withColumn("size", F.when(F.col("cap").isNotNull(), F.log(F.greatest("cap", F.lit(1e-12)))))


def join_series(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Further series, aligned to the panel's rows by (dt, instrument)."""
    return df.join(extra, ["dt", "instrument"], "left")


def bundle_meta(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("instrument").alias("n_instruments"), F.count_distinct("dt").alias("n_dates"))


def intraday_readout(ticks: DataFrame) -> DataFrame:
    """Daily bars of ticks (instrument, ts, id, price): first and last by (ts, id), extremes, count and sum."""
    key = F.struct("ts", "id")
    return ticks.groupBy("instrument", F.to_date("ts").alias("dt")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count("price").alias("volume"), F.sum("price").alias("amount")
    )


def map_instruments(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """A whole-frame Python function of each instrument's rows (by date); only where no built-in expression does."""
    return df.groupBy("instrument").applyInPandas(lambda rows: run(rows.sort_values("dt", kind="stable")), schema)


def map_dates(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """A whole-frame Python function of each date's rows (by instrument)."""
    return df.groupBy("dt").applyInPandas(lambda rows: run(rows.sort_values("instrument", kind="stable")), schema)
