"""Spread plans (blocks of time, ranges of values, prefix scans) against one-task plans, pandas and numpy."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import expr as X
from quantloom.operators import ranks
from quantloom.plans import scans
from quantloom.plans import catalog_queries, panel_queries
from quantloom.plans.stages import Program, compute, window_calls
from quantloom.sources.shared import stored


@pytest.fixture(scope="module")
def panel(spark):
    r = random.Random(2)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(k) for k in range(90)]
    rows = [(d, i, *[None if r.random() < (0.5 if i == 3 else 0.1) else r.choice((r.random() * 10, 5.0)) for _ in range(3)]) for i in (1, 2, 3, 4) for d in days]
    return stored(spark.createDataFrame(rows, "dt date, instrument long, close double, volume double, amount double"), "panel")


c, v, a = (X.field(n) for n in ("close", "volume", "amount"))
TREES = {
    "ema": X.ema(c, 10), "slow": X.ema(v, 60, 5), "sma": X.sma(c, 9, 2), "flat": X.ema(c, 1), "window_of": X.ts_sum(X.ema(c, 4), 3),
    "median": X.ts_med(X.fill(c, 1.0), 7), "mad": X.ts_mad(X.fill(v, 0.0), 6), "rank": X.ts_rank(X.fill(c, 1.0), 8), "place": X.ts_argmax(X.fill(v, 0.0), 9), "back": X.delay(c, 11), "ahead": X.delay(c, -4),
    "count": X.ts_count(c, 12), "corr": X.ts_corr(X.fill(c, 1.0), X.fill(v, 2.0), 10), "bucket": X.bucket_sum(X.fill(c, 0.0), X.fill(v, 1.0), 10, 0.3, "low"), "spread": X.ts_sorted_mean_spread(X.fill(c, 0.0), X.fill(v, 1.0), 10, 0.25), "history": X.scale(c),
    "cross": X.cs_rank(c), "both": X.cs_rank(X.ts_mean(c, 2)), "weights": X.decay_linear(X.fill(c, 0.0), 6), "held": X.ts_turnover_ref_price(X.fill(c, 1.0), X.fill(v, 1.0) / 20, 30),
}


def by_cell(df):
    return {(r.dt, r.instrument): r for r in df.collect()}


def test_spread_equals_one_task(panel):
    whole, parts = by_cell(compute(panel, TREES)), by_cell(compute(panel, TREES, spread=20))
    assert whole.keys() == parts.keys() and len(whole) == 360
    for k, row in whole.items():
        for name in TREES:
            x, y = row[name], parts[k][name]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-12, abs=1e-12)), (k, name)


def test_recursive_means_equal_pandas(panel):
    rows = panel.toPandas().sort_values("dt")
    got = by_cell(compute(panel, TREES))
    for i, own in rows.groupby("instrument"):
        for name, column, alpha, least in (("ema", "close", 2 / 11, 1), ("slow", "volume", 2 / 61, 5), ("sma", "close", 2 / 9, 1), ("flat", "close", 1.0, 1)):
            expected = own[column].astype(float).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
            for d, e in zip(own["dt"], expected, strict=True):
                x = got[d, i][name]
                assert (x is None) == bool(pd.isna(e)) and (x is None or x == pytest.approx(e, rel=1e-12)), (name, i, d)


def test_no_python_in_plans(panel):
    plan = compute(panel, {n: TREES[n] for n in ("slow", "median", "cross")}, spread=20)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan


def test_long_series_over_many_blocks(spark, monkeypatch):
    n = 40_000  # four levels of blocks
    r = np.random.default_rng(5)
    x = r.normal(size=n)
    x[r.random(n) < 0.3] = np.nan
    rows = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "x": x})).select(F.lit(1).alias("instrument"), F.col("t").alias("_t"), F.when(~F.isnan("x"), F.col("x")).alias("x"))
    parts = []

    def noted(df, name):
        parts.append(df.select(F.spark_partition_id().alias("p")).distinct().count())
        return stored(df, name)

    monkeypatch.setattr(scans, "stored", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scans.recursive_means(rows, {"m": ("x", 0.05, 1)}, n - 1, spread=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts[0] > 1
    out = got.orderBy("_t").toPandas()["m"].to_numpy()
    expected = pd.Series(x).ewm(alpha=0.05, adjust=False).mean().to_numpy()
    assert np.allclose(out, expected, rtol=1e-11, atol=1e-13, equal_nan=True)


def test_ranks_by_ranges(spark):
    r = random.Random(7)
    rows = [(k % 3 if k % 7 else None, r.choice([None, 1.0, r.random(), r.random() * 1e-14, -2.0])) for k in range(900)]
    df = ranks.average_ranked(ranks.cs_ranked(spark.createDataFrame(rows, "g int, x double"), {"least": F.col("x")}, ["g"], 7), {"mean": F.col("x")}, ["g"], 7).collect()
    assert len(df) == len(rows)
    for row in df:
        own = [x for g, x in rows if g == row.g and x is not None]
        if row.x is None:
            assert row.least is None and row["mean"] is None
        else:
            below, ties = sum(x < row.x for x in own), sum(x == row.x for x in own)
            assert row.least == (below + 1) / len(own) and row["mean"] == below + (ties + 1) / 2


def test_small_factors_rank_apart(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(day, i, (i - 2.5) / 100, 1e11) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "dt date, instrument long, r double, amount double")
    tree = {"x": X.cs_rank(X.div(X.field("r"), X.field("amount")))}
    for spread in (0, 5):
        assert {r.instrument: r.x for r in compute(df, tree, spread=spread).collect()} == {i: i / 5 for i in range(1, 6)}


def test_a_wide_date_spreads_over_ranges(spark):
    df = spark.range(20_000).select(F.lit(1).alias("dt"), F.rand(3).alias("x"))
    placed = ranks.ranged(df, F.col("x"))
    assert placed.agg(F.max("_below"), F.countDistinct("_below")).first()[0] == 19_999
    program = Program({"x": X.cs_rank(X.field("close"))}, lambda n: n.spark, set())
    assert list(program.ranks.values()) == ["close"]


def test_equal_window_calls_are_made_once(panel):
    texts = {"a": "CASE WHEN count(x) OVER (PARTITION BY dt, coalesce(g, 'U')) > 1 THEN lag(x, 2) OVER (ORDER BY dt) + sum(abs(x)) OVER (PARTITION BY i) END", "b": "array_sort(collect_list(named_struct('k', x)) OVER (ORDER BY dt))[0].k + count(x) OVER (PARTITION BY dt, coalesce(g, 'U'))"}
    calls, left = window_calls(texts)
    assert list(calls.values()) == ["count(x) OVER (PARTITION BY dt, coalesce(g, 'U'))", "lag(x, 2) OVER (ORDER BY dt)", "sum(abs(x)) OVER (PARTITION BY i)", "collect_list(named_struct('k', x)) OVER (ORDER BY dt)"]
    assert left == {"a": "CASE WHEN _c0 > 1 THEN _c1 + _c2 END", "b": "array_sort(_c3)[0].k + _c0"}
    plan = compute(panel, {"s": X.ts_std(c, 5), "m": X.ts_mean(c, 5), "k": X.ts_corr(c, v, 5)})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("stddev_samp(close") <= 2 and "percentile" not in compute(panel, {"q": X.ts_quantile(c, 5, 0.3)})._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_of_several_columns_count_from_the_rows(spark):
    df = spark.range(50).select(F.lit(1).alias("dt"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    two = ranks.average_ranked(df, {"rx": F.col("x"), "ry": F.col("y")})._jdf.queryExecution().optimizedPlan().toString()
    one = ranks.average_ranked(df, {"rx": F.col("x")})._jdf.queryExecution().optimizedPlan().toString()
    assert two.count("Join") == 2 * one.count("Join")


@pytest.mark.parametrize("name", ["rolling_cs_spearman_mean", "evaluate_ic_by_ranges", "alpha158_5"])
def test_panel_steps_equal_sql(same, name):
    plan = catalog_queries if name.startswith("alpha") else panel_queries
    same(plan.queries()[name], plan.oracle_sql()[name])
