"""Costly steps are made once, and what a task sorts does not grow with the rows."""

import re

from quantloom.operators import decisions as D
from quantloom.operators import evaluation as E
from quantloom.plans import archive_queries, decision_queries, panel_queries
from quantloom.sources.archive import evaluated


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_candidates_are_made_once(spark, sf):
    for df in (archive_queries._pairs(spark, sf), D.target_scores(evaluated(spark, sf)), D.base_score(evaluated(spark, sf)), decision_queries.queries()["mmr_select"](spark, sf)):
        # neither order lines nor expressions' texts are read again for each use
        assert "l_partkey" not in _plan(df) and "p_brand" not in _plan(df)


def test_references_go_to_the_candidates(spark, sf):
    assert "strategy=broadcast" in _plan(D.target_scores(evaluated(spark, sf)))


def test_batch_summary_is_dealt_by_its_rows(spark, monkeypatch):
    rows = [(k % 7, k, n, float((k * 37 + len(n) * k * k) % 101), float(k * 17 % 89)) for k in range(140) for n in ("a", "bb", "ccc")]
    long = spark.createDataFrame([(*r[:3], None if r[1] % 11 == 0 else r[3], r[4]) for r in rows] + [(99, 1, "a", 1.0, 2.0)], "dt int, instrument int, name string, factor double, y double")
    expected = {r.name: r for r in E.batch_summary(long, 5).collect()}
    monkeypatch.setattr(E, "RANKED", 20)
    df = E.batch_summary(long, 5)
    n = long.where("factor IS NOT NULL AND y IS NOT NULL").count()
    assert re.search(rf"RepartitionByExpression \[.*\], {-(-n // 20)}\b", _plan(df))
    got = {r.name: r for r in df.collect()}
    assert set(got) == set(expected) and all(got[k].n_dates == expected[k].n_dates == 7 and abs(got[k].mean_ic - expected[k].mean_ic) < 1e-12 for k in got)


def test_correlations_read_the_factors_alone(spark, sf):
    df = panel_queries.factors(spark, sf)
    assert df.columns == list(panel_queries.FACTORS)
    old = panel_queries.labelled(spark, sf).select(*panel_queries.FACTORS)
    rows = lambda x: sorted(str([None if v is None else round(v, 9) for v in r]) for r in x.collect())
    assert rows(df) == rows(old)
