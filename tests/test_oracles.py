"""A sample of the queries of each family against DuckDB; the driver runs them all."""

import pytest

from quantloom.plans import archive_queries, catalog_queries, decision_queries, io_queries, operator_queries, panel_queries

CHOSEN = {
    operator_queries: ("cs_rank", "ts_corr", "ts_rank", "ema", "bucket_sum", "power_pow", "cs_multi_reg_resid", "rsquare", "ts_turnover_ref_price"),
    panel_queries: ("filter_report", "derive_returns_float_cap_size", "evaluate_ic", "long_short_backtest", "neutralize", "redundant_vs_family", "batch_select", "dual_backtest", "pure_ic"),
    archive_queries: ("archive_upsert", "structural_near_duplicates", "family_funnel", "candidate_lineage", "donor_match"),
    decision_queries: ("winner_score", "candidate_decision", "branch_value", "mmr_select", "base_score"),
    io_queries: ("intraday_readout_stream", "sink_frame", "register_compute_factor"),
    catalog_queries: ("alpha158_2", "seed_baselines_2"),
}


@pytest.mark.parametrize("module, name", [(m, n) for m, names in CHOSEN.items() for n in names])
def test_equals_sql(same, module, name):
    same(module.queries()[name], module.oracle_sql()[name])


def test_names_are_unique():
    names = [n for m in CHOSEN for n in m.queries()]
    assert len(names) == len(set(names))


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).collect()
    assert len(row) == 1 and row[0].n_dates > 0
