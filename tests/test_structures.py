"""Conflict rounds, co-moment tables, diverse picks, bucketed tables and revised bars against plain versions."""

import datetime
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import expr as X
from quantloom.operators import decisions as D
from quantloom.operators import evaluation as E
from quantloom.operators import moments
from quantloom.operators.settle import first_kept
from quantloom.plans import archive_queries, panel_queries
from quantloom.plans.stages import compute
from quantloom.sources.buckets import BucketedTable
from quantloom.streaming import readout


def test_first_kept_equals_the_ordered_pass(spark):
    r = random.Random(1)
    for n, p in ((40, 0.2),):
        edges = [(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < p]
        cliques = [(i, f"c{i % 7}") for i in range(0, n, 2)]
        of = dict(cliques)
        kept, expected = [], {}
        for j in range(n):
            hit = next((i for i in kept if (i, j) in set(edges) or (i in of and of.get(j) == of[i])), None)
            if hit is None:
                kept.append(j)
            else:
                expected[j] = hit
        got = first_kept(spark.createDataFrame(edges, "earlier long, later long"), cliques=spark.createDataFrame(cliques, "item long, clique string"))
        assert {x.dropped: x.kept for x in got.collect()} == expected
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "earlier long, later long")
    assert {x.dropped: x.kept for x in first_kept(chain).collect()} == {1: 0, 3: 2, 5: 4}
    assert first_kept(chain.limit(0)).count() == 0


def test_a_dropped_factor_drops_no_other(spark):
    matrix = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.9), ("a", "d", 0.2), ("c", "x", 0.99)], "a string, b string, corr double")
    order = spark.createDataFrame([("a", "f", 0), ("b", "f", 1), ("c", "f", 2), ("d", "f", 3), ("x", "g", 0)], "name string, family string, position int")
    assert {r.name: r.redundant_with for r in E.redundant(matrix, order, 0.85).collect()} == {"a": None, "b": "a", "c": None, "d": None, "x": None}


def test_co_moments_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK", 3)  # several blocks
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 7)) * 10.0 ** r.integers(-14, 14, 7) + 1e3 * np.array([0, 1, 0, 0, 0, 0, 0])
    x[:, 5] = x[:, 2] * -2
    x[:, 6] = 4.25
    x[r.random(x.shape) < 0.2] = np.nan
    frame = pd.DataFrame(x, columns=[f"f{k}" for k in range(7)])
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"f{k} double" for k in range(7)))
    got = {(r_.a, r_.b): (r_.corr, r_.n) for r_ in moments.correlations(df, frame.columns, least=50).collect()}
    assert len(got) == 21
    for (a, b), (corr, n) in got.items():
        both = frame[[a, b]].dropna()
        assert n == len(both)
        assert corr is None if "f6" in (a, b) else corr == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)


def test_many_factors_plan_fast(spark):
    names = [f"f{k}" for k in range(200)]
    df = spark.range(64).select(*[F.rand(k).alias(n) for k, n in enumerate(names)])
    plan = moments.correlations(df, names)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 200_000 and moments.correlations(df, names).count() == 200 * 199 // 2


def test_promotion_refuses_a_copy_of_an_accepted_factor(spark):
    r = random.Random(2)
    base = [r.random() for _ in range(20)]
    noise = [r.random() for _ in range(20)]
    series = [("llm.old", k, v) for k, v in enumerate(base)] + [("llm.twin", k, -2 * v + 0.01 * noise[k]) for k, v in enumerate(base)] + [("llm.new", k, v) for k, v in enumerate(noise)]
    metrics = dict(quick_rank_ic_mean=0.05, quick_rank_icir=0.5, net_ann_return=0.4, net_excess_ann_return=0.3, net_sharpe=2.0, mean_turnover=0.1)
    rows = [(1, "f", "r", "candidate", "llm.twin", "research_keep", "x", 0.1, *metrics.values()), (2, "f", "r", "candidate", "llm.new", "research_keep", "y", 0.1, *metrics.values()), (3, "f", "r", "candidate", "llm.old", "research_winner", "z", 0.1, *metrics.values())]
    df = spark.createDataFrame(rows, "candidate_id long, family string, run_id string, role string, factor_name string, status string, expression string, corr_to_nearest_target double, " + ", ".join(f"{m} double" for m in metrics))
    near = D.nearest_accepted(df, df.where("candidate_id = 3"), spark.createDataFrame(series, "name string, key int, value double"))
    assert {x.candidate_id for x in near.collect()} == {1, 2}
    got = {x.candidate_id: (x.promoted, x.why) for x in D.promotions(df, family=near).collect()}
    assert got == {1: (False, "family_correlation"), 2: (True, "passed"), 3: (True, "passed")}


def test_nearest_series_without_rows_of_pairs(spark, monkeypatch):
    for name, size in (("ASKED", 7), ("ANSWERS", 3), ("ROWS", 2), ("PAIRS", 4)):
        monkeypatch.setattr(moments, name, size)  # several blocks
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(24, 12)), 1) + 1e4
    x[5] = x[9] * -3  # equal to 9 places: the greater name counts
    x[11] = 7.1  # doesn't vary
    x[3, :6] = x[3, 0] + 1e-9 * r.normal(size=6)  # hardly varies where others have cells
    x[r.random(x.shape) < 0.3] = np.nan
    x[20, 4:] = np.nan  # too few
    rows = [(f"n{i}", k, float(v)) for i, own in enumerate(x) for k, v in enumerate(own) if not np.isnan(v)]
    series = spark.createDataFrame(rows, "name string, key int, value double")
    group = lambda i: "gh"[i % 2] if i else None
    asked = spark.createDataFrame([(group(i), f"n{i}") for i in range(24)], "`group` string, name string")
    found = moments.nearest_series(series, asked, asked.where("name <> 'n7'"), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    best = {}
    for row in found.collect():
        best[row.name] = max(best.get(row.name, (-1.0, "", 0.0)), (round(row["corr"], 9), row.matched, row["corr"]))
    expected = {}
    for i in range(1, 24):
        for j in range(1, 24):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if i == j or j == 7 or group(i) != group(j) or both.sum() < 4 or np.ptp(x[i][both]) == 0 or np.ptp(x[j][both]) == 0:
                continue
            corr = abs(np.corrcoef(x[i][both], x[j][both])[0, 1])
            expected[f"n{i}"] = max(expected.get(f"n{i}", (-1.0, "")), (round(corr, 9), f"n{j}"))
    assert {n: v[1] for n, v in best.items()} == {n: v[1] for n, v in expected.items()}
    for n, v in best.items():
        assert v[2] == pytest.approx(expected[n][0], abs=2e-6)


def test_anchor_flags(spark):
    rows = [(1, "f", "r", "candidate", "research_keep", False, False), (2, "f", "r", "candidate", "research_winner", False, False), (3, "f", "r", "candidate", "research_keep", True, True), (4, "f", "r", "candidate", "research_keep", True, None)]
    metrics = ("quick_rank_ic_mean", "quick_rank_icir", "net_ann_return", "net_excess_ann_return", "net_sharpe", "mean_turnover")
    df = spark.createDataFrame(rows, "candidate_id long, family string, run_id string, role string, status string, eligible_for_best_node boolean, corr_guard_blocked boolean")
    df = df.withColumns({m: F.lit(1.0 if m != "mean_turnover" else 0.1) for m in metrics})
    got = {x.candidate_id: x.reasons for x in D.select_anchor(df).collect()}
    assert got == {1: "not_eligible_for_best_node", 2: "", 3: "corr_guard_blocked", 4: ""}
    other = df.withColumn("true_parent_corr_guard_blocked", F.lit(1))
    assert {x.reasons for x in D.select_anchor(other).where("candidate_id = 3").collect()} == {"true_parent_corr_guard_blocked"}


def test_diverse_picks_look_at_whole_families(spark):
    # nine near copies lead by score; the tenth is unlike them all
    rows = [(k, "f", f"b{k % 2}", 10.0 - k * 0.01, "m", "u", "s", ["t"], ["x"], ["w"]) for k in range(9)] + [(9, "f", "z", 9.0, "n", "v", "q", ["o"], ["y"], ["p"]), (10, "f", "y", 0.0, "a", "b", "c", ["d"], ["e"], ["g"])]
    df = spark.createDataFrame(rows, "candidate_id long, family string, branch string, base_score double, motif string, mutation string, operator_skeleton string, economic_tags array<string>, calls array<string>, words array<string>")
    df = df.withColumn("expression", F.concat(F.element_at("calls", 1), F.lit("(abc, "), F.element_at("words", 1), F.lit("xyz)")))
    got = [x.candidate_id for x in D.mmr_select(df, n=2).orderBy("position").collect()]
    assert got == [0, 9]
    assert [x.candidate_id for x in D.mmr_select(df.where("candidate_id = 3"), n=3).collect()] == [3]


def test_bucketed_table_touches_only_its_keys(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"
    t = BucketedTable(spark, path, ["k"], "at", 16)
    assert t.upsert(spark.createDataFrame([], "k long, v string, at int")) == []
    first = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("at"))
    assert len(t.upsert(first)) == 16
    assert len(t.compact()) == 16 and t.compact() == []
    touched = t.upsert(spark.createDataFrame([(3, "new", 2), (3, "newer", 3), (5000, "added", 1), (7, "too old", 0)], "k long, v string, at int"))
    assert len(touched) <= 3
    files = t.manifest()["files"]
    assert sorted(b for b, of in files.items() if len(of) > 1) == sorted(touched)
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 1001 and got[3] == "newer" and got[5000] == "added" and got[7] == "old"
    again = BucketedTable(spark, path, ["k"], "at", 16)
    assert sorted(again.compact()) == sorted(touched)
    assert {r.k: r.v for r in again.read().collect()} == got
    wider = spark.createDataFrame([(8, "wide", 9, 1.5)], "k long, v string, at int, extra double")
    again.upsert(wider)
    rows = again.read()
    assert "extra" in rows.columns and rows.where("k = 8").first().extra == 1.5 and rows.count() == 1001


def test_two_runs_of_a_stream_equal_one(spark):
    day = datetime.datetime(2024, 1, 1, 10)
    ticks = [(k % 3, day + datetime.timedelta(hours=5 * k), k, None if k == 7 else float(k % 11)) for k in range(40)]
    df = spark.createDataFrame(ticks, "instrument long, ts timestamp, id long, price double")
    found = []
    for cuts in ((F.lit(True),), (F.col("id") % 2 == 0, F.col("id") % 2 == 1)):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for cut in cuts:
            df.where(cut).coalesce(1).write.mode("append").parquet(f"{folder}/ticks")
            readout.keep_parts(spark, f"{folder}/ticks", f"{folder}/bars", f"{folder}/state")
        readout.keep_parts(spark, f"{folder}/ticks", f"{folder}/bars", f"{folder}/state")  # nothing new
        found.append({(r.instrument, r.dt): r for r in readout.merged_bars(spark.read.parquet(f"{folder}/bars/parts")).collect()})
    one, two = found
    assert one.keys() == two.keys() and sum(r.n_late for r in one.values()) == 0
    for k in one:
        assert one[k][:8] == two[k][:8] and one[k].closed == two[k].closed
    mark = max(t for _, t, i, _ in ticks if i % 2 == 0) - datetime.timedelta(days=1)
    late = sum(i % 2 == 1 and datetime.datetime.combine(t.date(), datetime.time()) + datetime.timedelta(days=1) <= mark for _, t, i, _ in ticks)
    assert sum(r.n_late for r in two.values()) == late > 0 and any(not r.closed for r in two.values())


def test_reference_price_of_a_long_window(spark):
    r = random.Random(4)
    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(k), 1, 10 + r.random(), r.random() * 1.2) for k in range(260)]
    df = spark.createDataFrame(rows, "dt date, instrument long, close double, turnover double")
    tree = X.ts_turnover_ref_price(X.field("close"), X.field("turnover"), 250)
    assert len(tree.spark) < 1500
    got = [x.p for x in compute(df, {"p": tree}).orderBy("dt").collect()]
    assert got[:249] == [None] * 249
    weights, rest = [], 1.0
    for _, _, _, t in reversed(rows[10:]):
        weights.append(rest * t)
        rest *= 1 - t
    prices = [p for _, _, p, _ in reversed(rows[10:])]
    assert got[-1] == pytest.approx(sum(w * p for w, p in zip(weights, prices)) / sum(weights), rel=1e-9)


def test_faded_sums_equal_their_definition(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(3, 300))
    x[1, 100] = np.nan
    rows = spark.createDataFrame([(i, k, k + 1, None if np.isnan(x[i, k]) else float(x[i, k])) for i in range(3) for k in range(300)], "instrument int, dt int, _rn int, x double")
    for n, half in ((52, 13.0), (100, 1.5), (7, 100.0), (1, 1.0)):
        got = np.array([np.nan if v.s is None else v.s for v in E.faded(rows, {"s": F.col("x")}, n, half).orderBy("instrument", "dt").collect()]).reshape(3, 300)
        w = 0.5 ** (np.arange(n)[::-1] / half)
        for i in range(3):
            for k in range(300):
                expected = (x[i, k - n + 1 : k + 1] * w).sum() if k >= n - 1 else np.nan
                assert np.isnan(got[i, k]) == np.isnan(expected) and (np.isnan(expected) or got[i, k] == pytest.approx(expected, rel=1e-9, abs=1e-12)), (n, half, i, k)
    plan = E.faded(rows, {"s": F.col("x")}, 52, 13.0)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


@pytest.mark.parametrize("name", ["archive_upsert", "archive_buckets"])
def test_inserted_rows_replace_no_row_of_the_archive(spark, name):
    folder = tempfile.mkdtemp(prefix="parts-", dir="/tmp")
    # ids as far as those that the inserted rows get
    rows = [(i, f"Brand#{i % 3}", "ECONOMY", i % 7) for i in (1, 2, 3, 4, 5, 6, 1_000_001, 1_000_002, 1_000_003, 1_000_009)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    got = sorted((r.candidate_id, r.status == "inserted", r.status == "revised", r.event) for r in archive_queries.queries()[name](spark, folder).collect())
    own = [(i, False, i % 3 == 0, 2 if i % 3 == 0 else 1) for i, *_ in rows]
    assert got == sorted(own + [(1_000_000 + i, True, False, 2) for i in (1, 2, 3, 4)])


def test_first_kept_names_every_candidate(spark, sf, same):
    query, sql = archive_queries.queries()["structural_first_kept"], archive_queries.oracle_sql()["structural_first_kept"]
    rows = query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/part.parquet").count() and any(r.duplicate_of for r in rows)
    dropped = sum(r.duplicate_of is not None for r in rows)
    assert sum(r.n_dropped for r in rows if r.duplicate_of is None) == dropped
    same(query, sql)


def test_bars_are_made_once_and_from_lines_brought_together(spark, sf):
    bars = panel_queries.panel_month(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert bars.index("partial_min_by") < bars.index("Exchange")  # lines move, not partial bars
    for name in ("undensify", "densify_grid", "rolling_cs_spearman_mean"):
        assert not any("lineitem" in f for f in panel_queries.queries()[name](spark, sf).inputFiles())


def test_rolling_likeness_reads_its_ranked_windows_once_made(spark):
    rows = [(datetime.date(2020, 1, d + 1), i, None if (i, d) == (2, 4) else v) for i in range(6) for d, v in enumerate([[1, 2, 2, 3, 5, 4], [4, 4, 1, 2, 3, 3], [1, 1, 2, 9, 9, 7], [7, 7, 7, 7, 7, 7], [2, 1, 3, 3, 1, 2], [5, 6, 1, 1, 6, 5]][i])]
    got = E.rolling_cs_spearman_mean(spark.createDataFrame(rows, "dt date, instrument int, x int"), "x", 3, 2)
    assert all("/ranked-" in f for f in got.inputFiles())
    frame = pd.DataFrame(rows, columns=["dt", "i", "x"]).pivot(index="dt", columns="i", values="x").astype(float)
    for r in got.collect():
        k = list(frame.index).index(r.dt)
        window = frame.iloc[max(0, k - 2) : k + 1]
        ok = [i for i in frame if len(window) == 3 and window[i].notna().all() and window[i].nunique() > 1]
        others = [window[r.instrument].rank().corr(window[j].rank()) for j in ok if j != r.instrument]
        assert (r.value is None) == (r.instrument not in ok or len(others) < 2)
        assert r.value is None or abs(r.value - np.mean(others)) < 1e-9
