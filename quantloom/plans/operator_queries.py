"""One query for each column operator, on the dense monthly or weekly panel, with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.functions import expr as X
from quantloom.plans.stages import compute, rounded, to_sql
from quantloom.sources.panel import grid, grid_sql

o, h, low, c, v, amt, vwap = (X.field(n) for n in ("open", "high", "low", "close", "volume", "amount", "vwap"))
turnover = X.field("turnover")
pre = X.delay(c, 1)
ret = X.div(c, pre) - 1
up = X.gt(c, pre)

#: name -> (panel, columns)
OPERATORS: dict[str, tuple[str, dict[str, X.Expr]]] = {
    "add_sub_mul": ("month", {"added": o + c, "subtracted": h - low, "multiplied": c * v}),
    "div_safe_div": ("month", {"ratio": X.div(o, c), "by_zero": X.div(c, c - c)}),
    "compare": ("month", {k: X.indicator(f(c, o)) for k, f in (("gt", X.gt), ("lt", X.lt), ("ge", X.ge), ("le", X.le), ("eq", X.eq), ("ne", X.ne))}),
    "boolean": ("month", {"conjunction": X.indicator(up & X.gt(v, 100)), "disjunction": X.indicator(up | X.gt(v, 100)), "negated": X.indicator(~up)}),
    "neg": ("month", {"value": -c}),
    "where_if_then_else": ("month", {"value": X.where(up, c, 0), "columns": X.where(up, h, low)}),
    "indicator": ("month", {"value": X.indicator(up)}),
    "abs_sign": ("month", {"absolute": X.abs_(c - o), "sign": X.sign(c - o)}),
    "log": ("month", {"value": X.log(v), "of_negative": X.log(o - c)}),
    "slog1p": ("month", {"value": X.slog1p(c - o)}),
    "inv": ("month", {"value": X.inv(c), "of_zero": X.inv(c - c)}),
    "sqrt": ("month", {"value": X.sqrt(v), "of_negative": X.sqrt(o - c)}),
    "power_pow": ("month", {"squared": X.power(X.div(c, o), 2), "negative_base": X.power(X.div(c - o, o), 0.5), "by_column": X.power(X.div(c, o), X.div(h, low))}),
    "rowmax_rowmin": ("month", {"larger": X.greater(o, pre), "smaller": X.less(o, pre)}),
    "upper_shadow": ("month", {"value": X.upper_shadow(o, h, c, pre)}),
    "cs_rank": ("month", {"value": X.cs_rank(c), "of_ties": X.cs_rank(X.indicator(up))}),
    "cs_zscore": ("month", {"value": X.cs_zscore(c)}),
    "cs_mean": ("month", {"value": X.cs_mean(c)}),
    "cs_sum": ("month", {"value": X.cs_sum(c)}),
    "cs_std": ("month", {"population": X.cs_std(c), "sample": X.cs_std(c, 1)}),
    "cs_skew": ("month", {"value": X.cs_skew(c)}),
    "scale": ("month", {"over_time": X.scale(c - o), "over_date": X.scale(c - o, axis="cross")}),
    "indneutralize": ("month", {k: X.indneutralize(c, k) for k in ("sector", "industry", "subindustry")}),
    "cs_reg_resid": ("month", {"value": X.cs_reg_resid(c, v)}),
    "cs_multi_reg_resid": ("month", {"value": X.cs_multi_reg_resid(c, v, h)}),
    "rowmax_cs_rowmin_cs": ("month", {"largest": X.cs_max(c), "smallest": X.cs_min(c)}),
    "ts_sum": ("month", {"value": X.ts_sum(v, 5)}),
    "ts_mean": ("month", {"value": X.ts_mean(c, 5), "longer": X.ts_mean(c, 20)}),
    "ts_std": ("month", {"value": X.ts_std(c, 10)}),
    "ts_var": ("month", {"value": X.ts_var(c, 10)}),
    "ts_ir": ("month", {"value": X.ts_ir(c, 10)}),
    "ts_skew": ("month", {"value": X.ts_skew(c, 10)}),
    "ts_kurt": ("month", {"value": X.ts_kurt(c, 10)}),
    "ts_med": ("month", {"value": X.ts_med(c, 10)}),
    "ts_mad": ("month", {"value": X.ts_mad(c, 10)}),
    "ts_count": ("week", {"value": X.ts_count(c, 10)}),
    "count": ("month", {"value": X.count_true(up, 10)}),
    "sumif": ("month", {"value": X.sumif(v, 10, up)}),
    "product": ("month", {"value": X.product(X.div(c, o), 5)}),
    "ts_max_ts_min": ("month", {"largest": X.ts_max(h, 10), "smallest": X.ts_min(low, 10)}),
    "ts_max_diff_min_diff": ("month", {"from_max": X.ts_max_diff(c, 10), "from_min": X.ts_min_diff(c, 10), "spread": X.ts_min_max_diff(c, 10)}),
    "ts_argmax_ts_argmin": ("month", {"of_max": X.ts_argmax(c, 10), "of_min": X.ts_argmin(c, 10)}),
    "highday_lowday": ("month", {"high": X.highday(h, 10), "low": X.lowday(low, 10)}),
    "ts_rank": ("month", {"value": X.ts_rank(c, 10)}),
    "ts_quantile": ("month", {"low": X.ts_quantile(c, 10, 0.2), "high": X.ts_quantile(c, 10, 0.8)}),
    "delay_ref": ("month", {"back": X.delay(c, 3), "ahead": X.delay(c, -2)}),
    "delta": ("month", {"value": X.delta(c, 3)}),
    "wide_returns": ("month", {"value": X.wide_returns(c)}),
    "ts_pct_change": ("month", {"value": X.ts_pct_change(c, 3)}),
    "decay_linear": ("month", {"value": X.decay_linear(c, 10)}),
    "wma": ("month", {"value": X.wma(c, 10)}),
    "weighted_mean": ("month", {"value": X.weighted_mean(c, 10, 5), "flat": X.weighted_mean(c, 10)}),
    "ts_exp_weighted_mean_lagged": ("week", {"value": X.ts_exp_weighted_mean_lagged(c, 10)}),
    "volume_weighted_mean": ("month", {"value": X.volume_weighted_mean(c, v, 10)}),
    "ema": ("week", {"value": X.ema(c, 10)}),
    "macd": ("week", {"value": X.macd(c, 12, 26)}),
    "sma": ("week", {"value": X.sma(c, 9, 2)}),
    "ts_corr": ("week", {"value": X.ts_corr(c, v, 10)}),
    "ts_cov": ("month", {"value": X.ts_cov(X.log(c), X.log(v), 10)}),
    "slope": ("month", {"value": X.slope(c, 10)}),
    "rsquare": ("month", {"value": X.rsquare(c, 10)}),
    "resi": ("month", {"value": X.resi(c, 10)}),
    "regbeta": ("month", {"value": X.regbeta(c, 6)}),
    "regression_slope_rsq_residual": ("month", {"slope": X.regression_slope(c, o, 10), "rsq": X.regression_rsq(c, o, 10), "residual": X.regression_residual(c, o, 10)}),
    "bucket_sum": ("month", {"low": X.bucket_sum(ret, X.div(h, low), 20, 0.3, "low"), "high": X.bucket_sum(ret, X.div(h, low), 20, 0.3, "high")}),
    "ts_sorted_mean_spread": ("month", {"value": X.ts_sorted_mean_spread(ret, v, 20, 0.25)}),
    "ts_turnover_ref_price": ("month", {"value": X.ts_turnover_ref_price(c, turnover / 100, 10)}),
    "rel_volume_rel_amount_adv": ("month", {"volume": X.relative(v, 20), "amount": X.relative(amt, 20), "adv": X.adv(v, 20)}),
    "cntp_mean": ("month", {"value": X.cntp_mean(up, 10)}),
    "derived_fields": ("month", {"midprice": (h + low) / 2, "turnover_rate": turnover / 100, "adv10": X.adv(v, 10)}),
}


#: Operators whose panels may be very wide or long: the same trees, worked on in blocks of dates and ranges of values.
SPREAD = {
    "cs_rank_spread": ("month", {"value": X.cs_rank(c), "of_small": X.cs_rank(X.div(ret, amt * 1e9))}),
    "ts_windows_spread": ("month", {"median": X.ts_med(c, 10), "deviation": X.ts_mad(c, 10), "rank": X.ts_rank(c, 10), "low": X.bucket_sum(ret, X.div(h, low), 20, 0.3, "low"), "spread": X.ts_sorted_mean_spread(ret, v, 20, 0.25)}),
    "ema_macd_spread": ("week", {"ema": X.ema(c, 10), "macd": X.macd(c, 12, 26)}),
}


def _query(kind: str, columns: dict[str, X.Expr]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(compute(grid(spark, sf_dir, kind), columns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    spread = {name: lambda spark, sf_dir, kind=kind, columns=columns: rounded(compute(grid(spark, sf_dir, kind), columns, spread=30)) for name, (kind, columns) in SPREAD.items()}
    return {name: _query(*x) for name, x in OPERATORS.items()} | spread


def oracle_sql() -> dict[str, str]:
    return {name: to_sql(grid_sql(kind), columns) for name, (kind, columns) in (OPERATORS | SPREAD).items()}
