"""Windows as matrices in batches: the same as Spark's frames, whatever the batches, and no frame is left in the plan."""

import datetime
import math
import random

import pandas as pd
import pytest

from quantloom.catalog import bars158
from quantloom.functions import expr as X
from quantloom.plans.stages import compute

c, v = X.field("close"), X.field("volume")
SHAPES = {
    "sum": X.ts_sum(c, 4), "mean": X.ts_mean(c, 5), "std": X.ts_std(c, 5), "max": X.ts_max(c, 3), "min": X.ts_min(c, 3), "lag": X.delay(c, 2), "one": X.ts_mean(c, 1),
    "low": X.ts_quantile(c, 5, 0.2), "mid": X.ts_quantile(c, 4, 0.5), "top": X.ts_argmax(c, 5), "bottom": X.ts_argmin(c, 5), "rank": X.ts_rank(c, 6), "corr": X.ts_corr(c, v, 5), "cov": X.ts_cov(c, v, 4),
    "slope": X.slope(c, 7), "square": X.rsquare(c, 5), "bucket": X.bucket_sum(v, c, 6, 0.3, "high"), "spread": X.ts_sorted_mean_spread(v, c, 6, 0.3), "nested": X.ts_mean(X.ts_std(X.delta(c, 1), 3), 4), "mixed": X.ts_mean(X.cs_rank(c), 3),
}


def _panel(spark):
    rng = random.Random(7)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0]
    rows = []
    for k in range(9):
        for t in range(3 if k == 4 else 40):
            # equal cells, flat stretches, missing and not finite ones; one instrument is null
            x = rng.choice(odd) if k % 3 == 0 and rng.random() < 0.12 else 5.1 if k % 3 == 1 and t % 20 < 12 else round(rng.random(), 1)
            rows.append((None if k == 8 else f"i{k}", datetime.date(2020, 1, 1) + datetime.timedelta(t), x, rng.choice([1.0, 2.0, 3.0, None if rng.random() < 0.2 else 4.0])))
    return spark.createDataFrame(rows, "instrument string, dt date, close double, volume double")


@pytest.mark.parametrize("size", [1, 3, 10000])
def test_equals_frames_in_batches_of_any_size(spark, size):
    panel = _panel(spark)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {(r.dt, r.instrument): r for r in compute(panel, SHAPES).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    # Spark's own frames
    expected = compute(panel, SHAPES, spread=10**6).collect()
    assert len(got) == len(expected) == panel.count()
    for r in expected:
        for name in SHAPES:
            x, y = got[(r.dt, r.instrument)][name], r[name]
            same = x is None and y is None or x is not None and y is not None and (x == y or math.isnan(x) and math.isnan(y) or abs(x - y) <= 1e-9 * max(1, abs(y)))
            assert same, (size, name, r.instrument, r.dt, x, y)


def test_no_frame_is_left(spark):
    plan = compute(_panel(spark).selectExpr("*", "close AS open", "close AS high", "close AS low", "close AS vwap"), bars158.family(60))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "specifiedwindowframe" not in plan


def test_windows_of_recursive_means_of_windows_are_in_order(spark):
    """Recursive means deal an instrument's blocks to tasks: windows after them bring its rows together again."""
    rng = random.Random(3)
    rows = [(k, datetime.date(2020, 1, 1) + datetime.timedelta(t), rng.random()) for t in range(100) for k in range(6)]
    panel = spark.createDataFrame(rows, "instrument long, dt date, close double")
    trees = {"sum": X.ts_sum(X.sma(X.ts_mean(c, 2), 5, 2), 3), "again": X.ts_max(X.ema(X.ts_sum(X.ema(X.ts_mean(c, 2), 3), 2), 4), 5)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.instrument, r.dt): r for r in compute(panel, trees).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mean = lambda x, alpha: x.ewm(alpha=alpha, adjust=False).mean()
    for k in range(6):
        own = pd.Series([x for i, _, x in rows if i == k]).rolling(2).mean()
        expected = {"sum": mean(own, 2 / 5).rolling(3).sum(), "again": mean(mean(own, 2 / 4).rolling(2).sum(), 2 / 5).rolling(5).max()}
        for t in range(100):
            for name, series in expected.items():
                x, y = got[k, datetime.date(2020, 1, 1) + datetime.timedelta(t)][name], series[t]
                assert (x is None) == bool(pd.isna(y)) and (x is None or abs(x - y) <= 1e-9), (name, k, t, x, y)


def test_sums_add_in_the_order_of_the_texts(spark):
    """To the last bit: else windows of equal cells in another order may part in a rank."""
    rng = random.Random(5)
    x = [rng.randrange(1, 26) / 25 + rng.randrange(1, 26) / 25 for _ in range(400)]
    panel = spark.createDataFrame([(1, datetime.date(2020, 1, 1) + datetime.timedelta(t), a) for t, a in enumerate(x)], "instrument int, dt date, close double")
    got = compute(panel, {"sum": X.ts_sum(c, 20), "mean": X.ts_mean(c, 9), "weighted": X.weighted(c, [8, 7, 6, 5, 4, 3, 2, 1])}).orderBy("dt").collect()

    def added(cells):
        out = cells[0]
        for a in cells[1:]:
            out += a
        return out

    for t in range(19, len(x)):
        assert got[t]["sum"] == added(x[t - 19 : t + 1]) and got[t]["mean"] == added(x[t - 8 : t + 1]) / 9, t
        assert got[t]["weighted"] == added([(8.0 - i) * x[t - i] for i in range(8)]), t
