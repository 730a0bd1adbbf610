"""Queries of panel preparation, evaluation and redundancy, with DuckDB forms written apart from the Spark ones."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.catalog import formulaic101
from quantloom.functions import expr as X
from quantloom.operators import evaluation as E
from quantloom.operators import prep as P
from quantloom.plans.stages import compute, rounding, to_sql
from quantloom.sources.dimensions import levels, scan_industry
from quantloom.sources.panel import MONTH_SQL, WEEK_SQL, densify, grid, grid_sql, panel_month, panel_week, scan_panel, undensify
from quantloom.sources.shared import shared_path, stored
from quantloom.sources.sinks import save_frame

c, v, h, low = (X.field(n) for n in ("close", "volume", "high", "low"))
#: Factors that the evaluation queries use.
FACTORS = {"factor": formulaic101.FACTORS[13], "f_rev": -X.delta(c, 3), "f_vol": -X.ts_std(X.wide_returns(c), 6), "f_rank": X.cs_rank(v), "f_amp": X.div(h, low), "f_twin": X.cs_rank(v) * 2 + 1}
MIN = 5
Query = Callable[[SparkSession, str], DataFrame]


def shown(df: DataFrame) -> DataFrame:
    """Doubles rounded as in the oracle."""
    return df.select(*[F.expr(rounding(n, spark=True)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel's closes, stored: the grid's dates, instruments and cells are all read from there."""
    return stored(panel_month(spark, sf_dir).select("dt", "instrument", "close"), "closes")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel rows with the factors, returns, label and a cap, stored: evaluations read it several times."""
    cells = grid(spark, sf_dir, mark="listed")
    rows = compute(cells, FACTORS, tuple(cells.columns)).where("listed").drop("listed")
    return stored(P.own_returns(E.forward_return(rows, "close", 5)).withColumn("cap", F.col("amount")), "labelled")


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors alone on the monthly panel's rows, stored: correlations need neither labels nor fields."""
    rows = compute(grid(spark, sf_dir, mark="listed"), FACTORS, ("listed",)).where("listed")
    return stored(rows.drop("listed"), "factors")


LABELLED = f"""p AS ({MONTH_SQL}), f AS ({to_sql(grid_sql(), FACTORS, digits=None)}),
fy AS (SELECT p.*, p.amount AS cap, lead(p.close, 5) OVER w / nullif(p.close, 0) - 1 AS y, p.close / nullif(lag(p.close) OVER w, 0) - 1 AS "returns", {", ".join(f"f.{n}" for n in FACTORS)}
  FROM p JOIN f ON p.dt = f.dt AND p.instrument = f.instrument WINDOW w AS (PARTITION BY p.instrument ORDER BY p.dt))"""


def _near(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e300 THEN {x} * 1048577::DOUBLE - ({x} * 1048577::DOUBLE - {x}) ELSE {x} END"


def _avg_rank(x: str, by: str = "dt") -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {_near(x)}) + (count(*) OVER (PARTITION BY {by}, {_near(x)}) - 1) / 2.0)"


PAIRS = f"pr AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dt) AS n_ FROM fy WHERE factor IS NOT NULL AND y IS NOT NULL) WHERE n_ >= {MIN})"
ICS = f"ic AS (SELECT dt, count(*) AS n, corr(factor, y) AS ic, corr(rf, ry) AS rank_ic FROM (SELECT *, {_avg_rank('factor')} AS rf, {_avg_rank('y')} AS ry FROM pr) GROUP BY dt)"
GROUPED = f"gr AS (SELECT *, least(5, ceil(round(rank() OVER (PARTITION BY dt ORDER BY {_near('factor')}) / count(*) OVER (PARTITION BY dt)::DOUBLE * 5, 9)))::INT AS grp FROM pr)"
TURN = """ds AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS prev FROM (SELECT DISTINCT dt FROM gr)),
tn AS (SELECT g.dt, g.grp, 1 - sum(CASE WHEN b.instrument IS NOT NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE AS turnover
  FROM gr g JOIN ds ON g.dt = ds.dt LEFT JOIN gr b ON b.dt = ds.prev AND b.instrument = g.instrument AND b.grp = g.grp GROUP BY 1, 2),
dp AS (SELECT gr.dt, avg(CASE WHEN grp = 5 THEN y END) AS long_, avg(CASE WHEN grp = 1 THEN y END) AS short_, avg(y) AS universe FROM gr GROUP BY 1),
da AS (SELECT dp.dt, long_ - short_ AS gross, a.turnover AS long_turnover, b.turnover AS short_turnover, (a.turnover + b.turnover) * 0.001 AS cost,
  long_ - short_ - (a.turnover + b.turnover) * 0.001 AS net, long_ - a.turnover * 0.001 AS long_net, long_ - a.turnover * 0.001 - universe AS excess, universe, long_ AS long, short_ AS short
  FROM dp JOIN tn a ON a.dt = dp.dt AND a.grp = 5 JOIN tn b ON b.dt = dp.dt AND b.grp = 1)"""


def _sql(body: str, doubles: list[str], others: list[str], *parts: str) -> str:
    cols = ", ".join([*others, *[f"{rounding(d)} AS {d}" for d in doubles]])
    return f"WITH {', '.join([LABELLED, *parts])}, out AS ({body}) SELECT {cols} FROM out"


def ic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ic_by_date(labelled(spark, sf_dir), MIN)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.daily_portfolio(labelled(spark, sf_dir), 5, 10.0, MIN)


WINDOWS = [("search", "1990-01-01", "1998-12-31"), ("selection", "1999-01-01", "2005-12-31"), ("all", "1990-01-01", "2005-12-31")]
RULES = ("special", "suspended", "new", "liquidity")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_month(spark, sf_dir).withColumn("_liquid", P.trailing_mean("amount", 20))
    return P.filtered(df, [("special", P.not_special()), ("suspended", P.trading()), ("new", P.listed(6)), ("liquidity", P.above_quantile(F.col("_liquid"), 0.2))]).drop("_liquid")


_MARKED = f"""WITH p AS ({MONTH_SQL}), l AS (SELECT *, avg(amount) OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS liquid,
  row_number() OVER (PARTITION BY instrument ORDER BY dt) AS k FROM p),
q AS (SELECT dt, quantile_cont(liquid, 0.2) AS cut FROM l GROUP BY dt),
m AS (SELECT l.*, CASE WHEN coalesce(is_st, 0) <> 0 THEN 'special' WHEN trade_status <> 1 THEN 'suspended' WHEN k <= 6 THEN 'new' WHEN liquid < cut THEN 'liquidity' END AS dropped_by FROM l JOIN q ON l.dt = q.dt)"""


def _float_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cap_size(P.float_cap(P.own_returns(panel_month(spark, sf_dir)))).select("dt", "instrument", "returns", "float_shares", "float_cap", "cap", "size")


_FLOAT = f"""WITH p AS ({MONTH_SQL}), a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS "returns", abs(volume) / nullif(CASE WHEN turnover > 0 THEN turnover / 100 END, 0) AS raw FROM p WINDOW w AS (PARTITION BY instrument ORDER BY dt)),
b AS (SELECT *, quantile_cont(raw, 0.5) OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS med FROM a),
c AS (SELECT *, coalesce(last_value(med IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(med IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS float_shares FROM b),
d AS (SELECT *, CASE WHEN close > 0 AND float_shares > 0 THEN close * float_shares END AS float_cap,
  CASE WHEN count(nullif(amount, 0)) OVER w >= 21 THEN avg(nullif(amount, 0)) OVER w END AS proxy FROM c WINDOW w AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
e AS (SELECT *, coalesce(float_cap, proxy) AS cap FROM d), out AS (SELECT dt, instrument, "returns", float_shares, float_cap, cap, CASE WHEN cap IS NOT NULL THEN ln(greatest(cap, 1e-12)) END AS size FROM e)
SELECT dt, instrument, {", ".join(f'{rounding(x)} AS {x}' for x in ("float_shares", "float_cap", "cap", "size"))}, {rounding('"returns"')} AS "returns" FROM out"""


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.col("user_id").alias("instrument"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))


_NEUTRAL_ON = ["f_rank", "f_amp"]
_N2 = """n0 AS (SELECT *, count(factor) OVER (PARTITION BY dt) AS n_, CASE WHEN factor IS NOT NULL THEN f_rank END AS a, CASE WHEN factor IS NOT NULL THEN f_amp END AS b FROM fy),
n1 AS (SELECT dt, instrument, n_, factor - avg(factor) OVER (PARTITION BY dt) AS f, a - avg(a) OVER (PARTITION BY dt) AS a, b - avg(b) OVER (PARTITION BY dt) AS b FROM n0),
n2 AS (SELECT *, CASE WHEN sum(a * a) OVER w > 1e-12 THEN b - sum(b * a) OVER w / sum(a * a) OVER w * a ELSE b END AS b2, CASE WHEN sum(a * a) OVER w > 1e-12 THEN f - sum(f * a) OVER w / sum(a * a) OVER w * a ELSE f END AS f2 FROM n1 WINDOW w AS (PARTITION BY dt)),
n3 AS (SELECT dt, instrument, CASE WHEN n_ >= 5 THEN CASE WHEN sum(b2 * b2) OVER w > 1e-12 THEN f2 - sum(f2 * b2) OVER w / sum(b2 * b2) OVER w * b2 ELSE f2 END END AS factor FROM n2 WINDOW w AS (PARTITION BY dt))"""
_NAMES = list(FACTORS)
_LONG = "lo AS (" + " UNION ALL ".join(f"SELECT dt, instrument, '{n}' AS name, {n} AS factor, y FROM fy" for n in _NAMES) + ")"
_BATCH = f"""bs AS (SELECT a.name, a.n_nonnull, b.mean_ic, b.std_ic, coalesce(b.n_dates, NULL) AS n_dates, CASE WHEN b.std_ic > 1e-12 THEN b.mean_ic / b.std_ic END AS icir
  FROM (SELECT name, count(factor) AS n_nonnull FROM lo GROUP BY name) a LEFT JOIN (
    SELECT name, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, count(ic) AS n_dates FROM (
      SELECT name, dt, corr(rf, ry) AS ic FROM (SELECT *, {_avg_rank('factor', 'name, dt')} AS rf, {_avg_rank('y', 'name, dt')} AS ry FROM (
        SELECT *, count(*) OVER (PARTITION BY name, dt) AS n_ FROM lo WHERE factor IS NOT NULL AND y IS NOT NULL) WHERE n_ >= {MIN}) GROUP BY name, dt) GROUP BY name) b ON a.name = b.name)"""
_DUO = [(x, y) for i, x in enumerate(sorted(_NAMES)) for y in sorted(_NAMES)[i + 1 :]]
_MATRIX = "mx AS (" + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) >= 50 THEN corr({x}, {y}) END AS corr, count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) AS n FROM fy" for x, y in _DUO) + ")"
_DECORR = "dc AS (" + " UNION ALL ".join(f"SELECT count(*) AS n, '{t}' AS target, corr(factor, {t}) AS corr FROM fy WHERE factor IS NOT NULL AND " + " AND ".join(f"{x} IS NOT NULL" for x in _NAMES[1:4]) for t in _NAMES[1:4]) + ")"


def _summary(spark, sf_dir):
    return E.batch_summary(labelled(spark, sf_dir).select("dt", "instrument", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("factor")) for n in _NAMES])).alias("x")).select("dt", "instrument", "y", "x.*"), MIN)


def _stages(spark, sf_dir):
    return E.eval_windows(ic_daily(spark, sf_dir), WINDOWS)


_CASES = " UNION ALL ".join(f"SELECT '{s}' AS stage, * FROM ic WHERE dt BETWEEN DATE '{a}' AND DATE '{b}'" for s, a, b in WINDOWS)
_BACK = ["gross_ann_return", "net_ann_return", "gross_sharpe", "net_sharpe", "mean_turnover", "mean_cost_bps", "long_only_net_ann_return", "long_only_net_sharpe", "net_excess_ann_return"]


def _sharpe_sql(x: str) -> str:
    return f"CASE WHEN stddev_samp({x}) > 1e-12 THEN avg({x}) * (252 / 5.0) / (stddev_samp({x}) * sqrt(252 / 5.0)) END"


#: name -> (query, DuckDB SQL or None)
QUERIES: dict[str, tuple[Query, str | None]] = {
    "project_numeric": (
        lambda s, d: shown(P.numeric(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("string").alias("qty")), ["flag", "qty"])),
        f"SELECT l_orderkey, l_linenumber, NULL::DOUBLE AS flag, {rounding('l_quantity')} AS qty FROM lineitem",
    ),
    "scan_panel": (lambda s, d: shown(_scan(s, d)), None),
    "filter_regex": (lambda s, d: shown(panel_month(s, d).where(P.matches("^[0-9]*[05]$")).select("dt", "instrument", "close")), f"SELECT dt, instrument, {rounding('close')} AS close FROM ({MONTH_SQL}) WHERE instrument % 5 = 0"),
    "filter_panel": (lambda s, d: _marked(s, d).select("dt", "instrument", "dropped_by"), f"{_MARKED} SELECT dt, instrument, dropped_by FROM m"),
    "filter_report": (
        lambda s, d: P.filter_report(_marked(s, d), RULES),
        f"{_MARKED} SELECT count(*) AS rows_before, count(CASE WHEN dropped_by IS NULL THEN 1 END) AS rows_after, count(DISTINCT CASE WHEN dropped_by IS NULL THEN instrument END) AS instruments_after, "
        + ", ".join(f"count(CASE WHEN dropped_by = '{r}' THEN 1 END) AS dropped_{r}" for r in RULES)
        + " FROM m",
    ),
    "filter_limit_move": (
        lambda s, d: shown(P.own_returns(panel_month(s, d)).withColumn("pct_chg", F.col("returns") * 100).where(P.no_limit_move(50)).select("dt", "instrument", "pct_chg")),
        f"""SELECT dt, instrument, {rounding("pct_chg")} AS pct_chg FROM (SELECT dt, instrument, (close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY dt), 0) - 1) * 100 AS pct_chg FROM ({MONTH_SQL})) WHERE coalesce(abs(pct_chg) < 50, true)""",
    ),
    "filter_turnover_quantile": (
        lambda s, d: shown(panel_month(s, d).withColumn("ok", P.above_quantile(F.col("turnover"), 0.25)).where("ok").select("dt", "instrument", "turnover")),
        f"SELECT dt, instrument, {rounding('turnover')} AS turnover FROM (SELECT *, quantile_cont(turnover, 0.25) OVER (PARTITION BY dt) AS cut FROM ({MONTH_SQL})) WHERE turnover >= cut",
    ),
    "zero_volume_price_null": (
        lambda s, d: shown(P.zero_volume_prices(panel_month(s, d).withColumn("volume", F.when(F.col("instrument") % 3 == 0, 0.0).otherwise(F.col("volume")))).select("dt", "instrument", "volume", "open", "close")),
        f"SELECT dt, instrument, {rounding('volume')} AS volume, {rounding('open')} AS open, {rounding('close')} AS close FROM (SELECT dt, instrument, CASE WHEN instrument % 3 = 0 THEN 0.0 ELSE volume END AS volume, CASE WHEN instrument % 3 <> 0 THEN open END AS open, CASE WHEN instrument % 3 <> 0 THEN close END AS close FROM ({MONTH_SQL}))",
    ),
    "derive_returns_float_cap_size": (lambda s, d: shown(_float_cap(s, d)), _FLOAT),
    "broadcast_benchmark": (
        lambda s, d: shown(grid(s, d).select("dt", "instrument", "benchmark_open", "benchmark_close")),
        f"SELECT dt, instrument, {rounding('benchmark_open')} AS benchmark_open, {rounding('benchmark_close')} AS benchmark_close FROM ({grid_sql()})",
    ),
    "join_extra_series": (
        lambda s, d: shown(P.join_series(panel_month(s, d).select("dt", "instrument", "close"), panel_month(s, d).where("volume > 1000").select("dt", "instrument", F.col("amount").alias("extra")))),
        f"SELECT dt, instrument, {rounding('close')} AS close, CASE WHEN volume > 1000 THEN {rounding('amount')} END AS extra FROM ({MONTH_SQL})",
    ),
    "bundle_meta": (lambda s, d: P.bundle_meta(panel_month(s, d)), f"SELECT count(*) AS n_rows, count(DISTINCT instrument) AS n_instruments, count(DISTINCT dt) AS n_dates FROM ({MONTH_SQL})"),
    "densify_grid": (lambda s, d: shown(densify(_closes(s, d)).select("dt", "instrument", "close")), f"SELECT dt, instrument, {rounding('close')} AS close FROM ({grid_sql()})"),
    "undensify": (lambda s, d: shown(undensify(densify(_closes(s, d)), "close").select("dt", "instrument", "close")), f"SELECT dt, instrument, {rounding('close')} AS close FROM ({MONTH_SQL})"),
    "intraday_readout": (
        lambda s, d: shown(P.intraday_readout(_ticks(s, d))),
        f"SELECT instrument, dt, volume, {', '.join(f'{rounding(x)} AS {x}' for x in ('open', 'high', 'low', 'close', 'amount'))} FROM (SELECT user_id AS instrument, CAST(ts AS DATE) AS dt, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(value) AS volume, sum(value) AS amount FROM events GROUP BY 1, 2)",
    ),
    "forward_return": (lambda s, d: shown(labelled(s, d).select("dt", "instrument", "y")), _sql("SELECT dt, instrument, y FROM fy", ["y"], ["dt", "instrument"])),
    "evaluate_ic_daily": (lambda s, d: shown(ic_daily(s, d)), _sql("SELECT * FROM ic", ["ic", "rank_ic"], ["dt", "n"], PAIRS, ICS)),
    "evaluate_ic": (
        lambda s, d: shown(E.ic_summary(ic_daily(s, d))),
        _sql("SELECT avg(rank_ic) AS mean_ic, stddev_samp(rank_ic) AS std_ic, avg(CASE WHEN round(rank_ic, 12) > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END)::DOUBLE AS ic_positive_rate, count(rank_ic) AS n_dates, avg(rank_ic) / stddev_samp(rank_ic) AS icir, avg(rank_ic) / stddev_samp(rank_ic) * sqrt(252) AS icir_ann FROM ic", ["mean_ic", "std_ic", "ic_positive_rate", "icir", "icir_ann"], ["n_dates"], PAIRS, ICS),
    ),
    "pearson_ic": (
        lambda s, d: shown(E.ic_summary(ic_daily(s, d), "ic")),
        _sql("SELECT avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(CASE WHEN round(ic, 12) > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)::DOUBLE AS ic_positive_rate, count(ic) AS n_dates, avg(ic) / stddev_samp(ic) AS icir, avg(ic) / stddev_samp(ic) * sqrt(252) AS icir_ann FROM ic", ["mean_ic", "std_ic", "ic_positive_rate", "icir", "icir_ann"], ["n_dates"], PAIRS, ICS),
    ),
    "ic_win_rates": (
        lambda s, d: shown(E.win_rates(ic_daily(s, d))),
        _sql(" UNION ALL ".join(f"SELECT '{b}' AS bucket, avg(CASE WHEN round(m, 12) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS win_rate, count(*) AS n FROM (SELECT avg(rank_ic) AS m FROM ic WHERE rank_ic IS NOT NULL GROUP BY {k})" for b, k in (("day", "dt"), ("month", "date_trunc('month', dt)"), ("year", "date_trunc('year', dt)"))), ["win_rate"], ["bucket", "n"], PAIRS, ICS),
    ),
    "rolling_ic": (lambda s, d: shown(E.rolling_ic(ic_daily(s, d), 12)), _sql("SELECT dt, CASE WHEN count(rank_ic) OVER w = 12 THEN avg(rank_ic) OVER w END AS rolling_ic FROM ic WINDOW w AS (ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)", ["rolling_ic"], ["dt"], PAIRS, ICS)),
    "winsorize_mad": (
        lambda s, d: shown(E.winsorize_mad(labelled(s, d), "f_rev").select("dt", "instrument", "f_rev")),
        _sql("SELECT dt, instrument, CASE WHEN f_rev IS NOT NULL THEN least(greatest(f_rev, med - mad), med + mad) END AS f_rev FROM (SELECT *, quantile_cont(abs(f_rev - med), 0.5) OVER (PARTITION BY dt) * (1.4826 * 3) AS mad FROM (SELECT *, quantile_cont(f_rev, 0.5) OVER (PARTITION BY dt) AS med FROM fy))", ["f_rev"], ["dt", "instrument"]),
    ),
    "zscore_daily": (lambda s, d: shown(E.zscore_daily(labelled(s, d), "f_rev").select("dt", "instrument", "f_rev")), _sql("SELECT dt, instrument, CASE WHEN stddev_samp(f_rev) OVER w > 1e-12 THEN (f_rev - avg(f_rev) OVER w) / stddev_samp(f_rev) OVER w END AS f_rev FROM fy WINDOW w AS (PARTITION BY dt)", ["f_rev"], ["dt", "instrument"])),
    "quantile_groups": (lambda s, d: E.quantile_groups(E.pairs(labelled(s, d), MIN), 5).select("dt", "instrument", "grp"), _sql("SELECT * FROM gr", [], ["dt", "instrument", "grp"], PAIRS, GROUPED)),
    "group_returns": (lambda s, d: shown(E.group_returns(E.quantile_groups(E.pairs(labelled(s, d), MIN), 5))), _sql("SELECT dt, grp, avg(y) AS mean_return, count(*) AS n FROM gr GROUP BY 1, 2", ["mean_return"], ["dt", "grp", "n"], PAIRS, GROUPED)),
    "turnover_cost_daily": (
        lambda s, d: shown(daily(s, d)),
        _sql("SELECT * FROM da", ["long", "short", "universe", "long_turnover", "short_turnover", "gross", "cost", "net", "long_net", "excess"], ["dt"], PAIRS, GROUPED, TURN),
    ),
    "long_short_backtest": (
        lambda s, d: shown(E.backtest_summary(daily(s, d))),
        _sql(
            f"SELECT avg(gross) * (252 / 5.0) AS gross_ann_return, avg(net) * (252 / 5.0) AS net_ann_return, {_sharpe_sql('gross')} AS gross_sharpe, {_sharpe_sql('net')} AS net_sharpe, avg((long_turnover + short_turnover) / 2) AS mean_turnover, avg(cost) * 1e4 AS mean_cost_bps, avg(long_net) * (252 / 5.0) AS long_only_net_ann_return, {_sharpe_sql('long_net')} AS long_only_net_sharpe, avg(excess) * (252 / 5.0) AS net_excess_ann_return, count(*) AS n_dates FROM da",
            _BACK, ["n_dates"], PAIRS, GROUPED, TURN,
        ),
    ),
    "decay_periods": (
        lambda s, d: shown(E.decay(labelled(s, d), (1, 5, 10), "close", MIN)),
        _sql(
            f"SELECT period, avg(ic) AS mean_ic, count(ic) AS n_dates FROM (SELECT dt, period, corr(rf, ry) AS ic FROM (SELECT *, {_avg_rank('factor', 'dt, period')} AS rf, {_avg_rank('y', 'dt, period')} AS ry FROM (SELECT *, count(*) OVER (PARTITION BY dt, period) AS n_ FROM st WHERE factor IS NOT NULL AND y IS NOT NULL) WHERE n_ >= {MIN}) GROUP BY 1, 2) GROUP BY 1",
            ["mean_ic"], ["period", "n_dates"],
            "st AS (" + " UNION ALL ".join(f"SELECT dt, instrument, factor, {k} AS period, lead(close, {k}) OVER (PARTITION BY instrument ORDER BY dt) / nullif(close, 0) - 1 AS y FROM fy" for k in (1, 5, 10)) + ")",
        ),
    ),
    "neutralize": (lambda s, d: shown(E.neutralize(labelled(s, d), _NEUTRAL_ON, MIN).select("dt", "instrument", "factor")), _sql("SELECT * FROM n3", ["factor"], ["dt", "instrument"], _N2)),
    "style_exposures": (lambda s, d: shown(_styled(s, d).withColumn("nlsize", F.round("nlsize", 4)).select("dt", "instrument", *E.STYLES)), None),
    "merge_extra_exposures": (lambda s, d: shown(_merged(s, d)), None),
    "fill_exposures": (lambda s, d: shown(E.fill_exposures(labelled(s, d), ["f_rev"]).select("dt", "instrument", "f_rev")), _sql("SELECT dt, instrument, coalesce(f_rev, quantile_cont(f_rev, 0.5) OVER (PARTITION BY dt), 0.0) AS f_rev FROM fy", ["f_rev"], ["dt", "instrument"])),
    "style_diagnostics": (
        lambda s, d: shown(E.style_diagnostics(labelled(s, d), ["f_rank", "f_amp", "f_rev"])),
        _sql("SELECT count(*) AS n_styles, avg(abs(corr)) AS mean_abs_corr, max(abs(corr)) AS max_abs_corr, arg_max(name, abs(corr)) AS top_style, arg_max(corr, abs(corr)) AS top_corr FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, corr(factor, {n}) AS corr FROM fy" for n in ("f_rank", "f_amp", "f_rev")) + ")", ["mean_abs_corr", "max_abs_corr", "top_corr"], ["n_styles", "top_style"]),
    ),
    "pure_ic": (lambda s, d: shown(_pure(s, d)), None),
    "batch_summary": (lambda s, d: shown(_summary(s, d)), _sql("SELECT * FROM bs", ["mean_ic", "std_ic", "icir"], ["name", "n_nonnull", "n_dates"], _LONG, _BATCH)),
    "batch_select": (lambda s, d: shown(E.batch_select(_summary(s, d), 3)), _sql("SELECT * FROM bs WHERE abs(mean_ic) >= 0 ORDER BY round(icir, 9) DESC NULLS LAST, name LIMIT 3", ["mean_ic", "std_ic", "icir"], ["name", "n_nonnull", "n_dates"], _LONG, _BATCH)),
    "eval_windows": (lambda s, d: shown(_stages(s, d)), _sql(f"SELECT stage, count(rank_ic) AS n, avg(rank_ic) AS mean_ic, stddev_samp(rank_ic) AS std_ic FROM ({_CASES}) GROUP BY stage", ["mean_ic", "std_ic"], ["stage", "n"], PAIRS, ICS)),
    "factor_corr_matrix": (lambda s, d: shown(E.corr_matrix(factors(s, d), _NAMES)), _sql("SELECT * FROM mx", ["corr"], ["a", "b", "n"], _MATRIX)),
    "decorrelation_diag": (
        lambda s, d: shown(E.decorrelation(labelled(s, d), "factor", _NAMES[1:4])),
        _sql("SELECT max(n) AS n, arg_max(target, abs(corr)) AS nearest, arg_max(corr, abs(corr)) AS corr, max(abs(corr)) AS abs_corr, avg(abs(corr)) AS mean_abs_corr FROM dc", ["corr", "abs_corr", "mean_abs_corr"], ["n", "nearest"], _DECORR),
    ),
    "redundant_vs_family": (
        lambda s, d: E.redundant(E.corr_matrix(factors(s, d), _NAMES), _rows(s, [(n, "a" if k < 2 else "b", k) for k, n in enumerate(_NAMES)], ("name", "family", "position")), 0.30),
        # an ordered pass over each family's names, as a fold; a kept name is a list of one
        _sql(
            "SELECT f.name, CASE WHEN NOT list_contains(k.kept, f.name) THEN list_filter(k.kept, lambda x: coalesce(mp.m[x || '|' || f.name], 0) >= 0.30)[1] END AS redundant_with FROM fam f JOIN kp k ON f.family = k.family, mp", [], ["name", "redundant_with"], _MATRIX,
            "mp AS (SELECT map(list(a || '|' || b), list(abs(corr))) AS m FROM (SELECT a, b, corr FROM mx UNION ALL SELECT b, a, corr FROM mx) WHERE corr IS NOT NULL)",
            "fam AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{'a' if k < 2 else 'b'}', {k})" for k, n in enumerate(_NAMES)) + ") AS t(name, family, position))",
            "kp AS (SELECT family, list_reduce(names, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: coalesce(m[k || '|' || x[1]], 0) >= 0.30)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM (SELECT family, list([name] ORDER BY position) AS names FROM fam GROUP BY 1), mp)",
        ),
    ),
    "redundant_vs_parent": (
        lambda s, d: shown(E.redundant_vs_parent(E.corr_matrix(factors(s, d), _NAMES), _rows(s, _PARENTS, ("name", "parent")))),
        _sql("SELECT p.name, p.parent, corr, CASE WHEN abs(corr) >= 0.98 THEN 'hard' WHEN abs(corr) >= 0.95 THEN 'soft' END AS verdict FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in (("f_twin", "f_rank"), ("f_amp", "f_vol"), ("f_rev", "factor"))) + ") AS p(name, parent) LEFT JOIN (SELECT a, b, corr FROM mx UNION ALL SELECT b, a, corr FROM mx) m ON p.name = m.a AND p.parent = m.b", ["corr"], ["name", "parent", "verdict"], _MATRIX),
    ),
}
_PARENTS = [("f_twin", "f_rank"), ("f_amp", "f_vol"), ("f_rev", "factor")]


def _rows(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A small table of names."""
    cells = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


#: Weekly styles; their windows fit the weeks at hand.
_WINDOWS = {"beta": (52, 13.0), "momentum": (60, 4, 26.0), "deviation": (52, 9.0), "cumulative": (12, 4), "shares": (4, 13, 52)}


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = stored(panel_week(spark, sf_dir), "panel")
    market = panel.groupBy("dt").agg(F.avg("close").alias("_m"))
    market = market.select("dt", (F.try_divide("_m", F.lag("_m").over(Window.orderBy("dt"))) - 1).alias("market_return"))  # a row a date
    rows = P.own_returns(panel).join(market, "dt").withColumns({"cap": F.col("amount"), "turnover": F.col("volume") / (F.lit(1000.0) + F.col("instrument")) * 100})
    return E.style_exposures(rows, **_WINDOWS)


def _dots(n: int, half: float, *lists: str) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: pow(0.5::DOUBLE, ({n} - i) / {half}::DOUBLE) * {' * '.join(f'{x}[i]' for x in lists)}))"


_TB, _TD = sum(0.5 ** (i / 13.0) for i in range(52)), sum(0.5 ** (i / 9.0) for i in range(52))
STYLED = f"""wk AS ({WEEK_SQL}), mk AS (SELECT dt, m / nullif(lag(m) OVER (ORDER BY dt), 0) - 1 AS mr FROM (SELECT dt, avg(close) AS m FROM wk GROUP BY 1)),
y0 AS (SELECT wk.dt, wk.instrument, mr, ln(amount) AS size, pow(ln(amount), 3) AS cb, volume / (1000.0 + wk.instrument) * 100 AS turnover, close / nullif(lag(close) OVER (PARTITION BY wk.instrument ORDER BY wk.dt), 0) - 1 AS ret FROM wk JOIN mk ON wk.dt = mk.dt),
y1 AS (SELECT *, CASE WHEN ret > -1 THEN ln(1 + ret) END AS lr, CASE WHEN mr IS NOT NULL THEN ret END AS rb, CASE WHEN mr IS NOT NULL AND ret IS NOT NULL THEN mr END AS xb, (cb - avg(cb) OVER d) - covar_pop(cb, size) OVER d / nullif(var_pop(size) OVER d, 0) * (size - avg(size) OVER d) AS nlsize FROM y0 WINDOW d AS (PARTITION BY dt)),
y2 AS (SELECT *, CASE WHEN count(rb) OVER b = 52 THEN list(rb) OVER b END AS ly, CASE WHEN count(rb) OVER b = 52 THEN list(xb) OVER b END AS lx, CASE WHEN count(lr) OVER m = 56 THEN list(lr) OVER m END AS lm, CASE WHEN count(ret) OVER b = 52 THEN list(ret) OVER b END AS ld, CASE WHEN count(lr) OVER c = 48 THEN list(lr) OVER c END AS lc,
  CASE WHEN count(turnover) OVER t1 = 4 THEN ln(greatest(sum(turnover) OVER t1, 1e-12)) END AS stom, CASE WHEN count(turnover) OVER t2 = 13 THEN ln(greatest(sum(turnover) OVER t2, 1e-12)) END AS stoq, CASE WHEN count(turnover) OVER b = 52 THEN ln(greatest(sum(turnover) OVER b, 1e-12)) END AS stoa FROM y1
  WINDOW b AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 51 PRECEDING AND CURRENT ROW), m AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 59 PRECEDING AND 4 PRECEDING), c AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 47 PRECEDING AND CURRENT ROW),
  t1 AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), t2 AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
y3 AS (SELECT *, {_dots(52, 13.0, 'lx')} / {_TB!r} AS mx, {_dots(52, 13.0, 'ly')} / {_TB!r} AS my, {_dots(52, 13.0, 'lx', 'lx')} / {_TB!r} AS xx, {_dots(52, 13.0, 'lx', 'ly')} / {_TB!r} AS xy, {_dots(52, 13.0, 'ly', 'ly')} / {_TB!r} AS yy, {_dots(52, 9.0, 'ld')} / {_TD!r} AS md, {_dots(52, 9.0, 'ld', 'ld')} / {_TD!r} AS dd, {_dots(56, 26.0, 'lm')} AS rs,
  list_transform(range(1, 13), lambda k: list_sum(lc[(12 - k) * 4 + 1:48])) AS cu FROM y2),
ys AS (SELECT dt, instrument, size, round(nlsize, 4) AS nlsize, CASE WHEN ly IS NOT NULL AND xx - mx * mx > 1e-12 THEN (xy - mx * my) / (xx - mx * mx) END AS beta, CASE WHEN ly IS NOT NULL AND xx - mx * mx > 1e-12 THEN sqrt(greatest(yy - my * my - (xy - mx * my) / (xx - mx * mx) * (xy - mx * my), 0)) END AS hsigma, CASE WHEN lm IS NOT NULL THEN rs END AS rstr,
  CASE WHEN ld IS NOT NULL THEN sqrt(greatest(dd - md * md, 0)) END AS dastd, CASE WHEN lc IS NOT NULL THEN list_max(cu) - list_min(cu) END AS cmra, stom, stoq, stoa FROM y3)"""
_STYLE_NAMES = ("size", "nlsize", "beta", "hsigma", "rstr", "dastd", "cmra", "stom", "stoq", "stoa")
QUERIES["style_exposures"] = (QUERIES["style_exposures"][0], f"WITH {STYLED} SELECT dt, instrument, {', '.join(f'{rounding(x)} AS {x}' for x in _STYLE_NAMES)} FROM ys")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two styles with further exposures: a new one, one whose name is taken, and a constant one."""
    rows = stored(_styled(spark, sf_dir).select("dt", "instrument", "close", "size", "beta"), "styled")
    extra = rows.select("dt", "instrument", F.when(F.col("instrument") % 3 > 0, F.log("close")).alias("price"), F.lit(1.0).alias("size"), F.lit(2.0).alias("same"))
    out, kept = E.merge_extra_exposures(rows.drop("close"), extra, ["size", "beta"])
    return out.select("dt", "instrument", *kept)


QUERIES["merge_extra_exposures"] = (
    QUERIES["merge_extra_exposures"][0],
    f"WITH {STYLED}, mg AS (SELECT ys.dt, ys.instrument, size, beta, CASE WHEN ys.instrument % 3 > 0 THEN ln(wk.close) END AS price FROM ys JOIN wk ON ys.dt = wk.dt AND ys.instrument = wk.instrument), out AS (SELECT dt, instrument, "
    + ", ".join(f"coalesce({x}, quantile_cont({x}, 0.5) OVER (PARTITION BY dt), 0.0) AS {x}" for x in ("size", "beta", "price"))
    + f" FROM mg) SELECT dt, instrument, {', '.join(f'{rounding(x)} AS {x}' for x in ('size', 'beta', 'price'))} FROM out",
)


def _pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mode, dt, n, rank_ic of the factor as it is, of its residual, and of both sides' residuals."""
    rows = labelled(spark, sf_dir)
    return E.pure_ic(rows, _NEUTRAL_ON, MIN)


def _residual_sql(name: str, column: str) -> str:
    """The column's residual on f_rank and f_amp, date by date: each regressor made orthogonal to those before it."""
    return f"""{name}0 AS (SELECT *, count({column}) OVER (PARTITION BY dt) AS n_, CASE WHEN {column} IS NOT NULL THEN f_rank END AS a, CASE WHEN {column} IS NOT NULL THEN f_amp END AS b FROM fy),
{name}1 AS (SELECT dt, instrument, n_, {column} - avg({column}) OVER (PARTITION BY dt) AS f, a - avg(a) OVER (PARTITION BY dt) AS a, b - avg(b) OVER (PARTITION BY dt) AS b FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN sum(a * a) OVER w > 1e-12 THEN b - sum(b * a) OVER w / sum(a * a) OVER w * a ELSE b END AS b2, CASE WHEN sum(a * a) OVER w > 1e-12 THEN f - sum(f * a) OVER w / sum(a * a) OVER w * a ELSE f END AS f2 FROM {name}1 WINDOW w AS (PARTITION BY dt)),
{name}3 AS (SELECT dt, instrument, CASE WHEN n_ >= 5 THEN CASE WHEN sum(b2 * b2) OVER w > 1e-12 THEN f2 - sum(f2 * b2) OVER w / sum(b2 * b2) OVER w * b2 ELSE f2 END END AS r FROM {name}2 WINDOW w AS (PARTITION BY dt))"""


QUERIES["pure_ic"] = (
    QUERIES["pure_ic"][0],
    _sql(
        f"SELECT mode, dt, count(*) AS n, corr(rf, ry) AS rank_ic FROM (SELECT *, {_avg_rank('f', 'mode, dt')} AS rf, {_avg_rank('y', 'mode, dt')} AS ry FROM (SELECT *, count(*) OVER (PARTITION BY mode, dt) AS n_ FROM pm WHERE f IS NOT NULL AND y IS NOT NULL) WHERE n_ >= {MIN}) GROUP BY 1, 2", ["rank_ic"], ["mode", "dt", "n"],
        _residual_sql("q", "factor"), _residual_sql("u", "y"),
        "pm AS (SELECT 'none' AS mode, dt, factor AS f, y FROM fy UNION ALL SELECT 'factor_only', fy.dt, q3.r, fy.y FROM fy JOIN q3 ON fy.dt = q3.dt AND fy.instrument = q3.instrument UNION ALL SELECT 'partial', fy.dt, q3.r, u3.r FROM fy JOIN q3 ON fy.dt = q3.dt AND fy.instrument = q3.instrument JOIN u3 ON fy.dt = u3.dt AND fy.instrument = u3.instrument)",
    ),
)


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month panel, written partitioned and read back with columns, dates and instruments pushed to the scan."""
    path = shared_path(spark, "panel")
    panel_month(spark, sf_dir).write.parquet(path)
    return scan_panel(spark, path, ["close", "volume", "absent"], "1996-01-01", "1998-12-31", list(range(1, 8)))


QUERIES["scan_panel"] = (QUERIES["scan_panel"][0], f"SELECT dt, instrument, {rounding('close')} AS close, {rounding('volume')} AS volume FROM ({MONTH_SQL}) WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND instrument BETWEEN 1 AND 7")


_SPEARMAN = f"""WITH g AS ({grid_sql()}), a AS (SELECT dt, instrument, CASE WHEN count(close) OVER w = 10 THEN list(close) OVER w END AS a FROM g WINDOW w AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
x AS (SELECT dt, instrument, generate_subscripts(a, 1) AS p, unnest(a) AS v FROM a WHERE a IS NOT NULL),
r AS (SELECT dt, instrument, p, rank() OVER (PARTITION BY dt, instrument ORDER BY v) + (count(*) OVER (PARTITION BY dt, instrument, v) - 1) / 2.0 AS k FROM x),
q AS (SELECT l.dt, l.instrument, m.instrument AS other, corr(l.k, m.k) AS rho FROM r l JOIN r m ON l.dt = m.dt AND l.p = m.p AND l.instrument <> m.instrument GROUP BY 1, 2, 3),
o AS (SELECT a.dt, a.instrument, CASE WHEN count(rho) >= 5 THEN avg(rho) END AS value FROM a LEFT JOIN q ON a.dt = q.dt AND a.instrument = q.instrument GROUP BY 1, 2)
SELECT dt, instrument, {rounding('value')} AS value FROM o"""

QUERIES |= {
    "evaluate_ic_by_ranges": (
        lambda s, d: shown(E.ic_by_date(labelled(s, d), MIN, wide=True)),
        _sql("SELECT * FROM ic", ["ic", "rank_ic"], ["dt", "n"], PAIRS, ICS),
    ),
}

QUERIES |= {
    "rolling_cs_spearman_mean": (lambda s, d: shown(E.rolling_cs_spearman_mean(densify(_closes(s, d)), "close", 10, 5)), _SPEARMAN),
    "price_panel": (lambda s, d: shown(E.price_panel(panel_month(s, d))), f"SELECT dt, instrument, {rounding('close')} AS close, {rounding('open')} AS open FROM ({MONTH_SQL}) WHERE close IS NOT NULL AND open IS NOT NULL"),
    "align_inputs": (
        lambda s, d: shown(_aligned(labelled(s, d))),
        _sql("SELECT dt, instrument, factor, y FROM fy WHERE factor IS NOT NULL AND y IS NOT NULL", ["factor", "y"], ["dt", "instrument"]),
    ),
    "dual_backtest": (lambda s, d: shown(E.dual_backtest(labelled(s, d), _NEUTRAL_ON, 5, 10.0, MIN)), None),
    "validate_required_fields": (lambda s, d: shown(P.required(panel_month(s, d), ("open", "close", "volume")).select("dt", "instrument", "open", "close", "volume")), f"SELECT dt, instrument, {', '.join(f'{rounding(x)} AS {x}' for x in ('open', 'close', 'volume'))} FROM ({MONTH_SQL})"),
    "scan_industry": (
        lambda s, d: _industries(s, d),
        "SELECT instrument, i[1:1] AS sector, i[1:3] AS industry, i AS subindustry FROM (SELECT lpad(s_suppkey::VARCHAR, 6, '0') || '.SH' AS instrument, n_name[1:1] || lpad(n_nationkey::VARCHAR, 2, '0') || n_name AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    ),
    "map_instruments": (lambda s, d: shown(_drawdowns(s, d)), f"SELECT dt, instrument, {rounding('drawdown')} AS drawdown FROM (SELECT dt, instrument, close / max(close) OVER (PARTITION BY instrument ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM ({MONTH_SQL}))"),
    "map_dates": (lambda s, d: shown(_medians(s, d)), f"SELECT dt, instrument, {rounding('apart')} AS apart FROM (SELECT dt, instrument, close - quantile_cont(close, 0.5) OVER (PARTITION BY dt) AS apart FROM ({MONTH_SQL}))"),
}


def _aligned(rows: DataFrame) -> DataFrame:
    return E.align_inputs(rows.where("factor IS NOT NULL").select("dt", "instrument", "factor"), rows.where("y IS NOT NULL").select("dt", "instrument", "y"))


def _industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as industry codes, written as csv and scanned."""
    path = shared_path(spark, "industry") + ".csv"
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    named = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    code = F.concat(F.lit("SH"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    save_frame(named.select(code.alias("code"), F.concat(F.substring("n_name", 1, 1), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "n_name").alias("industry")), path)
    return levels(scan_industry(spark, path))


def _drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(drawdown=rows["close"] / rows["close"].cummax() - 1)[["dt", "instrument", "drawdown"]]

    return P.map_instruments(panel_month(spark, sf_dir).select("dt", "instrument", "close"), run, "dt date, instrument bigint, drawdown double")


def _medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(apart=rows["close"] - rows["close"].median())[["dt", "instrument", "apart"]]

    return P.map_dates(panel_month(spark, sf_dir).select("dt", "instrument", "close"), run, "dt date, instrument bigint, apart double")


def _backtest_sql(mode: str, source: str, k: str) -> tuple[list[str], str]:
    """The backtest's tables over another source, under names of their own, and its summary."""
    parts = [re.sub(r"\b(fy|pr|gr|ds|tn|dp|da)\b", lambda m: source if m[0] == "fy" else m[0] + k, x) for x in (PAIRS, GROUPED, TURN)]
    status = f"CASE WHEN count(*) = 0 THEN 'failed' WHEN coalesce((SELECT stddev_samp(factor) FROM {source}) <= 1e-12, true) THEN 'degenerate_residual' ELSE 'ok' END"
    return parts, f"SELECT '{mode}' AS mode, {status} AS status, avg(net) * (252 / 5.0) AS net_ann_return, {_sharpe_sql('net')} AS net_sharpe, avg((long_turnover + short_turnover) / 2) AS mean_turnover, count(*) AS n_dates FROM da{k}"


(_raw, _raw_row), (_neutral, _neutral_row) = _backtest_sql("raw", "fy", "r"), _backtest_sql("neutral", "fn", "n")
QUERIES["dual_backtest"] = (
    QUERIES["dual_backtest"][0],
    _sql(f"{_raw_row} UNION ALL {_neutral_row}", ["net_ann_return", "net_sharpe", "mean_turnover"], ["mode", "status", "n_dates"], *_raw, _residual_sql("q", "factor"), "fn AS (SELECT fy.* EXCLUDE (factor), q3.r AS factor FROM fy JOIN q3 ON fy.dt = q3.dt AND fy.instrument = q3.instrument)", *_neutral),
)


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
