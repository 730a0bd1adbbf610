"""Factor evaluation: information coefficients, quantile backtests with costs, neutralisation, diagnostics.

Frames are keyed (dt, instrument); a factor is the column `factor`, its label `y` (the forward return).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators.moments import correlations
from quantloom.operators.ranks import average_ranked, near
from quantloom.operators.settle import first_kept
from quantloom.sources.shared import stored

#: Rows of a part whose dates' ranks one task makes; a date stays whole.
RANKED = 1 << 17


def _own() -> Window:
    return Window.partitionBy("instrument").orderBy("dt")


def _date() -> Window:
    return Window.partitionBy("dt")


def forward_return(df: DataFrame, price: str = "close", horizon: int = 5, name: str = "y") -> DataFrame:
    """Price `horizon` own rows ahead over the price now, less 1."""
    return df.withColumn(name, F.try_divide(F.lead(price, horizon).over(_own()), F.col(price)) - 1)


def average_rank(column: str, *by: str) -> Column:
    """Rank with ties averaged within `by` (the date), over rows where the column is present."""
    by = by or ("dt",)
    return F.rank().over(Window.partitionBy(*by).orderBy(near(F.col(column)))) + (F.count("*").over(Window.partitionBy(*by, near(F.col(column)))) - 1) / 2


def pairs(df: DataFrame, min_stocks: int = 10) -> DataFrame:
    """Rows that have both factor and label, on dates with at least min_stocks of them."""
    both = df.where(F.col("factor").isNotNull() & F.col("y").isNotNull())
    return both.withColumn("_n", F.count("*").over(_date())).where(F.col("_n") >= min_stocks).drop("_n")


def ic_by_date(df: DataFrame, min_stocks: int = 10, wide: bool = False) -> DataFrame:
    """dt, n, ic (Pearson) and rank_ic (Pearson of average ranks) of each date; wide: a date is ranked in ranges of values, not in one task."""
    if wide:
        rows = df.where(F.col("factor").isNotNull() & F.col("y").isNotNull()).select("dt", "factor", "y")
        enough = rows.groupBy(F.col("dt").alias("_dt")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_stocks)
        rows = rows.join(enough, F.col("dt") == F.col("_dt")).drop("_dt", "_n")
        ranked = average_ranked(rows, {"rf": near(F.col("factor")), "ry": near(F.col("y"))})
    else:
        ranked = pairs(df, min_stocks).withColumn("rf", average_rank("factor")).withColumn("ry", average_rank("y"))
    return ranked.groupBy("dt").agg(F.count("*").alias("n"), F.corr("factor", "y").alias("ic"), F.corr("rf", "ry").alias("rank_ic"))


def ic_summary(by_date: DataFrame, column: str = "rank_ic") -> DataFrame:
    """mean_ic, std_ic, icir, icir_ann, ic_positive_rate."""
    m = by_date.agg(F.avg(column).alias("mean_ic"), F.stddev_samp(column).alias("std_ic"), F.avg(F.when(F.round(column, 12) > 0, 1.0).when(F.col(column).isNotNull(), 0.0)).alias("ic_positive_rate"), F.count(column).alias("n_dates"))
    ratio = F.when(F.col("std_ic") > 1e-12, F.col("mean_ic") / F.col("std_ic"))
    return m.withColumn("icir", ratio).withColumn("icir_ann", ratio * math.sqrt(252))


def win_rates(by_date: DataFrame, column: str = "rank_ic") -> DataFrame:
    """Share of days, months and years with a positive (mean) coefficient."""
    out = None
    for name, key in (("day", F.col("dt")), ("month", F.trunc("dt", "month")), ("year", F.trunc("dt", "year"))):
        part = by_date.where(F.col(column).isNotNull()).groupBy(key.alias("k")).agg(F.avg(column).alias("m")).agg(F.lit(name).alias("bucket"), F.avg(F.when(F.round("m", 12) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def rolling_ic(by_date: DataFrame, window: int = 60, column: str = "rank_ic") -> DataFrame:
    """Mean coefficient of the last `window` dates (a row a date: one small partition)."""
    w = Window.orderBy("dt").rowsBetween(-(window - 1), 0)
    return by_date.select("dt", F.when(F.count(column).over(w) == window, F.avg(column).over(w)).alias("rolling_ic"))


def winsorize_mad(df: DataFrame, column: str = "factor", k: float = 3.0) -> DataFrame:
    """Clipped to the date's median plus or minus k * 1.4826 * median absolute deviation."""
    m = df.withColumn("_med", F.percentile(column, 0.5).over(_date()))
    m = m.withColumn("_mad", F.percentile(F.abs(F.col(column) - F.col("_med")), 0.5).over(_date()) * (1.4826 * k))
    x = F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("_med") - F.col("_mad")), F.col("_med") + F.col("_mad")))
    return m.withColumn(column, x).drop("_med", "_mad")


def zscore_daily(df: DataFrame, column: str = "factor") -> DataFrame:
    s = F.stddev_samp(column).over(_date())
    return df.withColumn(column, F.when(s > 1e-12, (F.col(column) - F.avg(column).over(_date())) / s))


def quantile_groups(df: DataFrame, n: int = 5) -> DataFrame:
    """grp 1..n by the factor's rank on the date; ties stay together."""
    share = F.rank().over(_date().orderBy(near(F.col("factor")))) / F.count("*").over(_date())
    return df.withColumn("grp", F.least(F.lit(n), F.ceil(F.round(share * n, 9))).cast("int"))


def group_returns(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("dt", "grp").agg(F.avg("y").alias("mean_return"), F.count("*").alias("n"))


def daily_portfolio(df: DataFrame, n: int = 5, cost_bps: float = 10.0, min_stocks: int = 10) -> DataFrame:
    """dt, gross, long_turnover, short_turnover, cost, net, long_net, universe of the long (group n) minus short (group 1) portfolio.

    A leg's turnover is the share of its members that were not members on the previous date, 1 on the first: each
    row looks at its instrument's last row, so one pass gives both legs.
    """
    g = quantile_groups(pairs(df, min_stocks), n)
    dates = g.select("dt").distinct().withColumn("_prev", F.lag("dt").over(Window.orderBy("dt")))  # a row a date
    before = g.withColumns({"_last": F.lag("dt").over(_own()), "_was": F.lag("grp").over(_own())}).join(dates, "dt")
    stays = F.coalesce((F.col("_last") == F.col("_prev")) & (F.col("_was") == F.col("grp")), F.lit(False))
    new = lambda k: F.avg(F.when(F.col("grp") == k, F.when(stays, 0.0).otherwise(1.0)))
    mean = lambda k: F.avg(F.when(F.col("grp") == k, F.col("y")))
    t = before.groupBy("dt").agg(mean(n).alias("long"), mean(1).alias("short"), F.avg("y").alias("universe"), new(n).alias("long_turnover"), new(1).alias("short_turnover")).where("long_turnover IS NOT NULL AND short_turnover IS NOT NULL")
    cost = (F.col("long_turnover") + F.col("short_turnover")) * (cost_bps / 1e4)
    t = t.withColumn("gross", F.col("long") - F.col("short")).withColumn("cost", cost)
    return t.withColumn("net", F.col("gross") - F.col("cost")).withColumn("long_net", F.col("long") - F.col("long_turnover") * (cost_bps / 1e4)).withColumn("excess", F.col("long_net") - F.col("universe"))


def annual(column: str, horizon: int) -> Column:
    return F.avg(column) * (252 / horizon)


def sharpe(column: str, horizon: int) -> Column:
    s = F.stddev_samp(column)
    return F.when(s > 1e-12, F.avg(column) * (252 / horizon) / (s * math.sqrt(252 / horizon)))


def backtest_summary(daily: DataFrame, horizon: int = 5) -> DataFrame:
    return daily.agg(
        annual("gross", horizon).alias("gross_ann_return"),
        annual("net", horizon).alias("net_ann_return"),
        sharpe("gross", horizon).alias("gross_sharpe"),
        sharpe("net", horizon).alias("net_sharpe"),
        F.avg((F.col("long_turnover") + F.col("short_turnover")) / 2).alias("mean_turnover"),
        (F.avg("cost") * 1e4).alias("mean_cost_bps"),
        annual("long_net", horizon).alias("long_only_net_ann_return"),
        sharpe("long_net", horizon).alias("long_only_net_sharpe"),
        annual("excess", horizon).alias("net_excess_ann_return"),
        F.count("*").alias("n_dates"),
    )


def decay(df: DataFrame, periods: Sequence[int] = (1, 5, 10), price: str = "close", min_stocks: int = 10) -> DataFrame:
    """period, mean_ic, n_dates for forward returns of several lengths, in one pass over stacked horizons."""
    w = df.withColumns({f"_y{p}": F.try_divide(F.lead(price, p).over(_own()), F.col(price)) - 1 for p in periods})
    stacked = w.select("dt", "instrument", "factor", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"_y{p}").alias("y")) for p in periods])).alias("s")).select("dt", "instrument", "factor", "s.*")
    by = Window.partitionBy("dt", "period")
    both = stacked.where(F.col("factor").isNotNull() & F.col("y").isNotNull()).withColumn("_n", F.count("*").over(by)).where(F.col("_n") >= min_stocks)

    daily = both.withColumn("rf", average_rank("factor", "dt", "period")).withColumn("ry", average_rank("y", "dt", "period")).groupBy("dt", "period").agg(F.corr("rf", "ry").alias("ic"))
    return daily.groupBy("period").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_dates"))


def fill_exposures(df: DataFrame, exposures: Sequence[str]) -> DataFrame:
    """Missing exposures become the date's median, then 0."""
    return df.withColumns({e: F.coalesce(F.col(e), F.percentile(e, 0.5).over(_date()), F.lit(0.0)) for e in exposures})


def varying(df: DataFrame, exposures: Sequence[str]) -> list[str]:
    """Exposures that are not constant over the data (one small aggregate)."""
    row = df.agg(*[F.stddev_samp(e).alias(e) for e in exposures]).first()
    return [e for e in exposures if row[e] is not None and row[e] > 1e-12]


def neutralize(df: DataFrame, exposures: Sequence[str], min_stocks: int = 10, column: str = "factor") -> DataFrame:
    """The column less its projections on the exposures, date by date: each exposure is first made orthogonal to those before it.

    Equal to the residual of the date's least squares with intercept. Missing on dates with fewer than min_stocks rows.
    """
    ok = F.col(column).isNotNull()
    n = F.count(F.when(ok, 1)).over(_date())
    work = df.withColumn("_n", n).withColumns({f"_x{k}": F.when(ok, F.col(e)) for k, e in enumerate(exposures)}).withColumn("_f", F.col(column))
    names = [*[f"_x{k}" for k in range(len(exposures))], "_f"]
    work = work.withColumns({c: F.col(c) - F.avg(c).over(_date()) for c in names})
    for k in range(len(exposures)):
        e = F.col(f"_x{k}")
        square = F.sum(e * e).over(_date())
        work = work.withColumns({c: F.when(square > 1e-12, F.col(c) - F.sum(F.col(c) * e).over(_date()) / square * e).otherwise(F.col(c)) for c in names[k + 1 :]})
    return work.withColumn(column, F.when(F.col("_n") >= min_stocks, F.col("_f"))).drop("_n", *names)


def faded(df: DataFrame, sums: dict[str, Column], n: int, half_life: float) -> DataFrame:
    """df with each named column: the sum of the last n values, of which each weighs half of one half_life rows later; null unless all are present.

    df: instrument, _rn (the row's number in its instrument, from 1). Rows are cut into blocks of n, so a window is the
    end of one block and the beginning of the next: a running sum backward from the one's end and one forward from the
    other's start, both with weights of their place in the block. Nothing is subtracted, so nothing cancels.
    """
    if n > 900 * half_life:
        raise ValueError("weights beyond 900 half-lives don't fit a double")
    own, block = _own(), Window.partitionBy("instrument", F.floor((F.col("_rn") - 1) / n)).orderBy("_rn")
    place = (F.col("_rn") - 1) % n
    weight = lambda k: F.pow(F.lit(0.5), k / half_life)
    made = {}
    for name, value in sums.items():
        grown = value * weight(-place)
        made |= {f"_n_{name}": F.count(value).over(own.rowsBetween(-(n - 1), 0)), f"_f_{name}": F.sum(grown).over(block.rowsBetween(Window.unboundedPreceding, 0)), f"_b_{name}": F.sum(grown).over(block.rowsBetween(0, Window.unboundedFollowing))}
    df = df.withColumns(made)
    df = df.withColumns({f"_b_{name}": F.lag(f"_b_{name}", n - 1).over(own) for name in sums})
    early = lambda name: F.when(place == n - 1, 0.0).otherwise(F.col(f"_b_{name}") * weight(place + n))
    return df.withColumns({name: F.when(F.col(f"_n_{name}") == n, F.col(f"_f_{name}") * weight(place) + early(name)) for name in sums}).drop(*made)


def style_exposures(
    df: DataFrame, beta: tuple[int, float] = (252, 63.0), momentum: tuple[int, int, float] = (504, 21, 126.0), deviation: tuple[int, float] = (252, 42.0), cumulative: tuple[int, int] = (12, 21), shares: tuple[int, int, int] = (21, 63, 252)
) -> DataFrame:
    """Adds the styles, from cap, returns, market_return and turnover; null where a window isn't full.

    size: log of cap. nlsize: its cube's residual on it, by date. beta, hsigma: slope of the returns on the market's
    and deviation of the residual over (rows, half-life). rstr: log returns of (rows) up to (lag) rows ago, faded by
    a half-life. dastd: faded deviation of returns over (rows, half-life). cmra: range of the log returns that
    accumulate over 1 to (blocks) blocks of (rows). stom, stoq, stoa: log of the turnover summed over so many rows.
    """
    base = df.withColumn("size", F.when(F.col("cap") > 0, F.log("cap"))).withColumn("_c", F.pow("size", F.lit(3.0)))
    slope = F.covar_pop("_c", "size").over(_date()) / F.when(F.var_pop("size").over(_date()) > 1e-12, F.var_pop("size").over(_date()))
    base = base.withColumn("nlsize", (F.col("_c") - F.avg("_c").over(_date())) - slope * (F.col("size") - F.avg("size").over(_date())))
    base = base.withColumn("_ln", F.when(F.col("returns") > -1, F.log1p("returns"))).withColumn("_both", F.when(F.col("market_return").isNotNull(), F.col("returns")))

    own = _own()
    m = base.withColumn("_rn", F.row_number().over(own)).withColumn("_x", F.when(F.col("_both").isNotNull(), F.col("market_return")))
    y, x, d = F.col("_both"), F.col("_x"), F.col("returns")
    n, half = beta
    total = sum(0.5 ** (i / half) for i in range(n))
    m = faded(m, {"_mx": x, "_my": y, "_xx": x * x, "_xy": x * y, "_yy": y * y}, n, half).withColumns({k: F.col(k) / total for k in ("_mx", "_my", "_xx", "_xy", "_yy")})
    m = m.withColumns({"_xx": F.col("_xx") - F.col("_mx") * F.col("_mx"), "_xy": F.col("_xy") - F.col("_mx") * F.col("_my"), "_yy": F.col("_yy") - F.col("_my") * F.col("_my")})
    m = m.withColumn("beta", F.when(F.col("_xx") > 1e-12, F.col("_xy") / F.col("_xx")))
    m = m.withColumn("hsigma", F.when(F.col("beta").isNotNull(), F.sqrt(F.greatest(F.col("_yy") - F.col("beta") * F.col("_xy"), F.lit(0.0)))))
    m = faded(m, {"rstr": F.col("_ln")}, momentum[0] - momentum[1], momentum[2]).withColumn("rstr", F.lag("rstr", momentum[1]).over(own))
    n, half = deviation
    total = sum(0.5 ** (i / half) for i in range(n))
    m = faded(m, {"_md": d, "_dd": d * d}, n, half).withColumn("_md", F.col("_md") / total)
    m = m.withColumn("dastd", F.when(F.col("_md").isNotNull(), F.sqrt(F.greatest(F.col("_dd") / total - F.col("_md") * F.col("_md"), F.lit(0.0)))))
    blocks, rows = cumulative
    upto = [F.sum("_ln").over(own.rowsBetween(-(k * rows - 1), 0)) for k in range(1, blocks + 1)]
    full = F.count("_ln").over(own.rowsBetween(-(blocks * rows - 1), 0)) == blocks * rows
    m = m.withColumns({f"_u{k}": u for k, u in enumerate(upto)} | {"_full": full})
    ends = [F.col(f"_u{k}") for k in range(blocks)]
    m = m.withColumn("cmra", F.when(F.col("_full"), F.greatest(*ends) - F.least(*ends) if blocks > 1 else F.lit(0.0)))
    for name, k in zip(("stom", "stoq", "stoa"), shares, strict=True):
        over = _own().rowsBetween(-(k - 1), 0)
        m = m.withColumn(name, F.when(F.count("turnover").over(over) == k, F.log(F.greatest(F.sum("turnover").over(over), F.lit(1e-12)))))
    return m.drop("_c", "_ln", "_both", "_rn", "_x", "_mx", "_my", "_xx", "_xy", "_yy", "_md", "_dd", "_full", *[f"_u{k}" for k in range(blocks)])


STYLES = ("size", "nlsize", "beta", "hsigma", "rstr", "dastd", "cmra", "stom", "stoq", "stoa")


def merge_extra_exposures(df: DataFrame, extra: DataFrame, exposures: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with further exposures joined by (dt, instrument), and the names that vary: of equal names the first stays.

    Missing ones become the date's median, then 0; constant columns are dropped.
    """
    new = [e for e in extra.columns if e not in ("dt", "instrument") and e not in df.columns]
    names = [*exposures, *new]
    filled = fill_exposures(df.join(extra.select("dt", "instrument", *new), ["dt", "instrument"], "left"), names)
    kept = varying(filled, names)
    return filled.drop(*[e for e in names if e not in kept]), kept


def pure_ic(df: DataFrame, exposures: Sequence[str], min_stocks: int = 10) -> DataFrame:
    """mode, dt, n, rank_ic: of the factor (none), of its residual on the exposures (factor_only), of both residuals (partial)."""
    rest = neutralize(df, exposures, min_stocks)
    modes = {"none": df, "factor_only": rest, "partial": neutralize(rest, exposures, min_stocks, "y")}
    out = None
    for mode, frame in modes.items():
        part = ic_by_date(frame.select("dt", "factor", "y"), min_stocks).select(F.lit(mode).alias("mode"), "dt", "n", "rank_ic")
        out = part if out is None else out.unionByName(part)
    return out


def style_diagnostics(df: DataFrame, exposures: Sequence[str]) -> DataFrame:
    """Pooled correlation of the factor with each exposure: count, mean and greatest absolute value, and its name."""
    row = df.agg(*[F.corr("factor", e).alias(e) for e in exposures])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(e).alias("name"), F.col(e).alias("corr")) for e in exposures])).alias("x")).select("x.*").where(F.col("corr").isNotNull())
    return long.agg(F.count("*").alias("n_styles"), F.avg(F.abs("corr")).alias("mean_abs_corr"), F.max(F.abs("corr")).alias("max_abs_corr"), F.max_by("name", F.struct(F.abs("corr"), "name")).alias("top_style"), F.max_by("corr", F.struct(F.abs("corr"), "name")).alias("top_corr"))


def long_factors(wide: DataFrame, factors: Sequence[str], keep: Sequence[str] = ("dt", "instrument")) -> DataFrame:
    """Factor columns as rows: keep, name, factor."""
    return wide.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("factor")) for f in factors])).alias("x")).select(*keep, "x.*")


def batch_summary(long: DataFrame, min_stocks: int = 10) -> DataFrame:
    """name, n_nonnull, mean_ic, std_ic, icir, n_dates of many factors at once; long: dt, instrument, name, factor, y."""
    counts = long.groupBy("name").agg(F.count("factor").alias("n_nonnull"))
    both = long.where(F.col("factor").isNotNull() & F.col("y").isNotNull()).select("name", "dt", "factor", "y")
    # as many parts as the rows need, so that what a task sorts does not grow with them
    both = both.repartition(max(1, math.ceil(both.count() / RANKED)), "name", "dt")
    ranked = both.withColumn("rf", average_rank("factor", "name", "dt")).withColumn("ry", average_rank("y", "name", "dt"))
    daily = ranked.groupBy("name", "dt").agg(F.corr("rf", "ry").alias("ic"), F.count("*").alias("_n")).where(F.col("_n") >= min_stocks)
    s = daily.groupBy("name").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count("ic").alias("n_dates"))
    return counts.join(s, "name", "left").withColumn("icir", F.when(F.col("std_ic") > 1e-12, F.col("mean_ic") / F.col("std_ic")))


def batch_select(summary: DataFrame, k: int = 5, min_nonnull: int = 0, min_abs_ic: float = 0.0) -> DataFrame:
    """The k best factors by icir (to 9 places), missing last, ties by name."""
    ok = summary.where((F.col("n_nonnull") >= min_nonnull) & (F.abs("mean_ic") >= min_abs_ic))
    return ok.orderBy(F.desc_nulls_last(F.round("icir", 9)), "name").limit(k)


def eval_windows(by_date: DataFrame, windows: Sequence[tuple[str, str, str]], column: str = "rank_ic") -> DataFrame:
    """stage, n, mean_ic, std_ic for several date windows of one factor (inclusive bounds)."""
    stages = F.array(*[F.when(F.col("dt").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(s)) for s, a, b in windows])
    return by_date.withColumn("stage", F.explode(F.array_compact(stages))).groupBy("stage").agg(F.count(column).alias("n"), F.avg(column).alias("mean_ic"), F.stddev_samp(column).alias("std_ic"))


# --- correlation and redundancy -----------------------------------------------------------------------------


def factor_corr(df: DataFrame, a: str, b: str, least: int = 50) -> Column:
    """Pooled Pearson correlation of two columns over rows with both; missing below `least` pairs."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(F.count_if(both) >= least, F.corr(a, b))


def corr_matrix(wide: DataFrame, factors: Sequence[str], least: int = 50) -> DataFrame:
    """a, b, corr, n of every pair of columns, pairwise complete, from one table of co-moments."""
    return correlations(wide, factors, least)


def decorrelation(wide: DataFrame, factor: str, targets: Sequence[str]) -> DataFrame:
    """Over rows complete on all targets: n, nearest target, its correlation and absolute value, mean absolute value."""
    rows = wide.dropna(subset=[factor, *targets])
    row = rows.agg(F.count("*").alias("n"), *[F.corr(factor, t).alias(t) for t in targets])
    long = row.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("corr")) for t in targets])).alias("x")).select("n", "x.*")
    key = F.struct(F.abs("corr"), "target")
    return long.agg(F.max("n").alias("n"), F.max_by("target", key).alias("nearest"), F.max_by("corr", key).alias("corr"), F.max(F.abs("corr")).alias("abs_corr"), F.avg(F.abs("corr")).alias("mean_abs_corr"))


def _both_ways(matrix: DataFrame) -> DataFrame:
    return matrix.select("a", "b", "corr").unionByName(matrix.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))


def redundant_vs_parent(matrix: DataFrame, parents: DataFrame, soft: float = 0.95, hard: float = 0.98) -> DataFrame:
    """name, parent, corr, verdict (hard, soft or null) of each factor that has a parent. matrix: a, b, corr; parents: name, parent."""
    met = parents.join(_both_ways(matrix).select(F.col("a").alias("name"), F.col("b").alias("parent"), "corr"), ["name", "parent"], "left")
    return met.withColumn("verdict", F.when(F.abs("corr") >= hard, "hard").when(F.abs("corr") >= soft, "soft"))


def redundant(matrix: DataFrame, order: DataFrame, limit: float) -> DataFrame:
    """name, redundant_with: the earliest kept factor of the family of a smaller position whose absolute correlation reaches the limit.

    matrix: a, b, corr; order: name, family, position. A factor that is itself dropped drops no other. Families are
    settled together, in rounds of joins over their edges.
    """
    place = lambda s: order.select(F.col("name").alias(s), F.col("family").alias(f"f{s}"), F.struct("position", "name").alias(f"p{s}"))
    edges = _both_ways(matrix).where(F.abs("corr") >= limit).join(place("a"), "a").join(place("b"), "b").where("pb < pa AND fa = fb")
    item = lambda s: F.struct(F.col(f"f{s}").alias("family"), F.col(f"p{s}.position").alias("position"), F.col(s).alias("name"))
    found = first_kept(edges.select(item("b").alias("earlier"), item("a").alias("later"))).select("dropped.family", F.col("dropped.name").alias("_name"), F.col("kept.name").alias("redundant_with"))
    return order.join(found.withColumnRenamed("family", "_family"), (F.col("name") == F.col("_name")) & F.col("family").eqNullSafe(F.col("_family")), "left").select("name", "redundant_with")


# --- alignment, raw and neutral backtests, likeness over time ----------------------------------------------


def price_panel(df: DataFrame) -> DataFrame:
    """Aligned close and open, rows that have both."""
    return df.select("dt", "instrument", "close", "open").where("close IS NOT NULL AND open IS NOT NULL")


def align_inputs(factor: DataFrame, label: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows whose key is in all inputs."""
    out = factor.join(label, ["dt", "instrument"])
    for x in others:
        out = out.join(x, ["dt", "instrument"])
    return out


def dual_backtest(df: DataFrame, exposures: Sequence[str], n: int = 5, cost_bps: float = 10.0, min_stocks: int = 10, horizon: int = 5) -> DataFrame:
    """mode (raw, neutral), status and the backtest of the factor as it is and of its residual on the exposures.

    A residual that hardly varies has the status degenerate_residual; a backtest without dates, failed.
    """
    out = None
    for mode, frame in (("raw", df), ("neutral", neutralize(df, exposures, min_stocks))):
        spread = frame.agg(F.stddev_samp("factor")).scalar()
        row = backtest_summary(daily_portfolio(frame, n, cost_bps, min_stocks), horizon).withColumn("_spread", spread)
        status = F.when(F.col("n_dates") == 0, "failed").when(F.coalesce(F.col("_spread") <= 1e-12, F.lit(True)), "degenerate_residual").otherwise("ok")
        row = row.select(F.lit(mode).alias("mode"), status.alias("status"), "net_ann_return", "net_sharpe", "mean_turnover", "n_dates")
        out = row if out is None else out.unionByName(row)
    return out


def rolling_cs_spearman_mean(grid: DataFrame, column: str, window: int = 20, min_obs: int = 10) -> DataFrame:
    """dt, instrument, value: mean Spearman correlation of an instrument's last `window` values with those of all others.

    Ranks are centred and scaled to length 1, so a correlation is an inner product and the mean over all
    others is one inner product with the date's sum of vectors: no pairs of instruments are made.
    Missing where the window is not full or flat, or with fewer than min_obs others.
    """
    w = _own().rowsBetween(-(window - 1), 0)
    cells = grid.select("dt", "instrument", F.when(F.count(column).over(w) == window, F.collect_list(F.col(column).cast("double")).over(w)).alias("a"))
    schema = ", ".join(f"{c} {t}" for c, t in cells.select("dt", "instrument").dtypes) + ", z array<double>"

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("a")
            have = np.array(lists.is_valid())
            a = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, window)
            # a cell's average rank, less the middle: half of the cells below it less those above, equal ones on both sides; NaN is above all
            c = np.zeros_like(a)
            for k in range(window):
                other = a[:, k : k + 1]
                above = (a > other) | (np.isnan(a) & ~np.isnan(other))
                below = (a < other) | (np.isnan(other) & ~np.isnan(a))
                c += (above.astype(np.float64) - below) / 2
            square = (c * c).sum(axis=1)
            flat = square <= 1e-12
            have[have] = ~flat
            z = (c[~flat] / np.sqrt(square[~flat])[:, None]).ravel()
            offsets = np.concatenate([[0], np.cumsum(have * window)]).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(z, pa.float64()), mask=pa.array(~have))
            yield pa.RecordBatch.from_arrays([batch.column("dt"), batch.column("instrument"), rows], ["dt", "instrument", "z"])

    # stored: the dates' sums and the result both read the vectors
    unit_ = stored(cells.mapInArrow(ranked, schema), "ranked")
    by_place = unit_.where("z IS NOT NULL").groupBy("dt").agg(*[F.sum(F.col("z")[p]).alias(f"v{p}") for p in range(window)], F.count("*").alias("n"))
    total = by_place.select(F.col("dt").alias("_dt"), F.array(*[f"v{p}" for p in range(window)]).alias("t"), "n")
    joined = unit_.join(total, F.col("dt") == F.col("_dt"), "left")
    dot = sum((F.col("z")[p] * F.col("t")[p] for p in range(1, window)), F.col("z")[0] * F.col("t")[0])
    return joined.select("dt", "instrument", F.when((F.col("n") - 1 >= min_obs) & F.col("z").isNotNull(), (dot - 1) / (F.col("n") - 1)).alias("value"))
