"""Queries of gates, decisions, ranking and search scores, with DuckDB forms written apart from the Spark ones: constants are typed in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.operators import candidates as C
from quantloom.operators import decisions as D
from quantloom.plans.archive_queries import _BASE, _PARENT, _PROFILE, _REFS, _SCORED, ALIKE, METRICS, Query, _eq, _jac, _pairs, _sql, winner_scores
from quantloom.plans.panel_queries import shown
from quantloom.sources.archive import SERIES_SQL, candidates, evaluated, series

_COMPLEXITY = r"len(regexp_extract_all(expression, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) + 0.08::DOUBLE * len(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*')) + 0.18::DOUBLE * {depth}"
_DEPTH = "list_max(list_transform(range(1, length(expression) + 1), lambda i: length(regexp_replace(expression[1:i], '[^(]', '', 'g')) - length(regexp_replace(expression[1:i], '[^)]', '', 'g'))))"
_COMPLEXITY = f"({_COMPLEXITY.format(depth=_DEPTH)})"


def _th(x: str, scale: float) -> str:
    return f"tanh(coalesce({x}, 0) / {scale}::DOUBLE)"


def _up(x: str, scale: float) -> str:
    return f"tanh(greatest(coalesce({x}, 0), 0) / {scale}::DOUBLE)"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def _ret(m: str) -> str:
    return f"CASE WHEN abs({m}) > 1e-12 THEN neutral_{m} / {m} END"


def _collapsed(m: str) -> str:
    return f"coalesce({m} > 0 AND neutral_{m} <= 0 AND coalesce({_ret(m)} < 0.25, true), false)"


_GUARD = f"NOT (role = 'candidate' AND coalesce(avg_abs_style_corr >= 0.20, false) AND {_collapsed('quick_rank_icir')} AND {_collapsed('net_sharpe')})"
_MATERIAL = "(coalesce(net_excess_ann_return - p_net_excess_ann_return >= 0.02, false) OR coalesce(quick_rank_icir - p_quick_rank_icir >= 0.05, false) OR coalesce(net_sharpe - p_net_sharpe >= 0.25, false))"
_BROAD = "list_filter([CASE WHEN quick_rank_icir - p_quick_rank_icir >= 0.02 THEN 'quick_rank_icir' END, CASE WHEN net_ann_return - p_net_ann_return >= 0.20 THEN 'net_ann_return' END, CASE WHEN net_excess_ann_return - p_net_excess_ann_return >= 0.05 THEN 'net_excess_ann_return' END], lambda x: x IS NOT NULL)"
_FLOOR = "(coalesce(quick_rank_icir >= 0.30, false) OR coalesce(quick_rank_ic_mean >= 0.03 AND net_sharpe >= 0, false))"
# gates of correlation, over the table with parents
_GOOD = "(coalesce(quick_rank_icir >= 0.15 AND net_sharpe >= 1.20, false) OR coalesce(net_excess_ann_return >= 0.05, false) OR coalesce(net_ann_return >= 1.50, false) OR coalesce(neutral_quick_rank_icir >= 0.08 AND neutral_net_sharpe >= 1.0, false))"
_STRONG = "coalesce(quick_rank_icir >= 0.50 AND net_sharpe >= 3.00, false)"
_NEAR = "coalesce(corr_to_nearest_target, avg_abs_target_corr)"
_ASSESSED = f"""as1 AS (SELECT *, {_NEAR} AS near, {_GOOD} AS good, {_STRONG} AS strong, {_MATERIAL} AS gains FROM wp),
asd AS (SELECT *, CASE WHEN near IS NULL THEN 'unknown' WHEN near <= 0.35 THEN 'excellent' WHEN near <= 0.55 THEN 'good' WHEN near <= 0.70 THEN 'acceptable' WHEN near <= 0.85 THEN 'weak' ELSE 'failed' END AS grade,
  CASE WHEN near IS NULL THEN 0 WHEN avg_abs_target_corr IS NOT NULL THEN round({_clamp('0.75 * (1 - near) + 0.25 * (1 - avg_abs_target_corr)')}, 4) ELSE round({_clamp('1 - near')}, 4) END AS dscore,
  CASE WHEN near IS NULL THEN 0 ELSE round(CASE WHEN near <= 0.35 THEN CASE WHEN good THEN 0.12 ELSE 0 END WHEN near <= 0.55 THEN CASE WHEN good THEN 0.08 ELSE 0 END WHEN near <= 0.70 THEN CASE WHEN good THEN 0.03 ELSE 0 END WHEN near <= 0.85 THEN -0.12 ELSE -0.24 END
    - CASE WHEN avg_abs_target_corr > 0.70 THEN 0.08::DOUBLE * {_clamp('(avg_abs_target_corr - 0.70) / (1 - 0.70)::DOUBLE')} ELSE 0 END, 4) END AS adjustment,
  CASE WHEN near IS NULL THEN 'pass' WHEN near > 0.90 THEN CASE WHEN strong OR gains THEN 'suppress_high_corr_reference' ELSE 'drop' END WHEN near > 0.85 AND NOT gains THEN 'drop' WHEN near > 0.75 AND NOT strong THEN 'suppress_winner' WHEN near > 0.70 THEN 'soft_penalty' ELSE 'pass' END AS gate FROM as1)"""
_NOVEL = """xs AS (SELECT rf.run_id, list(DISTINCT k.shape) AS shapes, list(DISTINCT k.motif) AS motifs, list(DISTINCT k.source_model) AS models FROM rf JOIN pf k ON rf.candidate_id = k.candidate_id GROUP BY 1),
xp AS (SELECT p.candidate_id, 0.35 * CASE WHEN coalesce(list_contains(shapes, mutation), false) THEN 0.0 ELSE 1.0 END + 0.30 * CASE WHEN coalesce(list_contains(motifs, motif), false) OR coalesce(motif = p_motif, false) THEN 0.0 ELSE 1.0 END
  + 0.25 * CASE WHEN coalesce(list_contains(models, source_model), false) OR coalesce(source_model = p_model, false) THEN 0.0 ELSE 1.0 END AS novel FROM pf p LEFT JOIN xs ON p.run_id = xs.run_id),
xq AS (SELECT e.candidate_id, novel::DOUBLE + 0.10::DOUBLE * greatest(0.0, 1 - coalesce(corr_to_nearest_target, 0)) AS exploration FROM e JOIN xp ON e.candidate_id = xp.candidate_id)"""
_KEEPS = """((p_mean_turnover IS NULL OR mean_turnover IS NULL OR mean_turnover <= greatest(p_mean_turnover * 2, 0.50)) AND len(better) > 0) OR (list_contains(better, 'quick_rank_ic_mean') AND list_contains(better, 'net_ann_return'))
  OR ((list_contains(better, 'net_excess_ann_return') OR list_contains(better, 'net_sharpe')) AND (p_mean_turnover IS NULL OR mean_turnover IS NULL OR mean_turnover <= p_mean_turnover * 1.25))"""
_DECIDED = f"""d1 AS (SELECT asd.*, exploration, list_filter([{', '.join(f"CASE WHEN {m} > p_{m} THEN '{m}' END" for m in METRICS[:5])}], lambda x: x IS NOT NULL) AS better FROM asd JOIN xq ON asd.candidate_id = xq.candidate_id),
d2 AS (SELECT *, CASE WHEN status = 'drop_redundant_family_exact' THEN 'exact_duplicate' WHEN role <> 'candidate' THEN 'baseline' WHEN p_id IS NULL OR coalesce({', '.join('p_' + m for m in METRICS)}) IS NULL THEN 'missing_parent'
  WHEN expression = p_expression THEN 'same_expression' WHEN lacks > 1 OR (net_sharpe IS NULL AND mean_turnover IS NULL) THEN 'incomplete' WHEN gate IN ('drop', 'suppress_high_corr_reference') THEN 'correlated' WHEN {_KEEPS} THEN 'improves'
  WHEN {_FLOOR} AND round(exploration, 9) >= 0.50 THEN 'explores' WHEN len(better) > 0 THEN 'trade_off' ELSE 'no_gain' END AS stage FROM d1),
d3 AS (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY candidate_id) AS turn FROM d2),
d4 AS (SELECT *, CASE WHEN stage = 'explores' AND turn > 2 THEN CASE WHEN len(better) > 0 THEN 'trade_off' ELSE 'no_gain' END ELSE stage END AS why FROM d3),
dd AS (SELECT *, CASE why WHEN 'exact_duplicate' THEN status WHEN 'baseline' THEN role WHEN 'improves' THEN 'research_keep' WHEN 'explores' THEN 'research_keep_exploratory' ELSE CASE WHEN status LIKE 'drop\\_redundant%' ESCAPE '\\' AND why IN ('trade_off', 'no_gain') THEN status ELSE 'research_drop' END END AS decision FROM d4)"""
_ALL = (_PARENT, _ASSESSED, _PROFILE, _REFS, _NOVEL, _DECIDED)
_FLOORED = "fl AS (SELECT *, max(CASE WHEN decision IN ('research_winner', 'research_keep', 'research_keep_exploratory') THEN 1 ELSE 0 END) OVER (PARTITION BY run_id) AS n_kept, role = 'candidate' AND decision NOT LIKE 'drop\\_redundant%' ESCAPE '\\' AND gate NOT IN ('drop', 'suppress_high_corr_reference') AND why <> 'incomplete' AS usable FROM dd), fk AS (SELECT *, row_number() OVER (PARTITION BY run_id, usable ORDER BY lacks, net_sharpe DESC NULLS LAST, net_ann_return DESC NULLS LAST, net_excess_ann_return DESC NULLS LAST, quick_rank_icir DESC NULLS LAST, quick_rank_ic_mean DESC NULLS LAST, mean_turnover ASC NULLS LAST, candidate_id) AS k FROM fl)"
_OK = f"role = 'candidate' AND decision = 'research_keep' AND lacks = 0 AND {_GUARD} AND gate IN ('pass', 'soft_penalty')"
_STANDARD = f"{_OK} AND quick_rank_icir >= 0.30 AND net_sharpe >= 1.5 AND mean_turnover <= 0.70"
_BROADLY = f"{_OK} AND net_sharpe - p_net_sharpe > 0 AND len({_BROAD}) > 0"


def _winner(guard: str, keys: list[str]) -> str:
    order = ", ".join(f"{'round(winner_score, 9)' if k == 'winner_score' else k} DESC NULLS LAST" for k in keys)
    return _sql(f"SELECT * FROM (SELECT dd.*, ws.winner_score AS score, row_number() OVER (PARTITION BY dd.run_id ORDER BY {order}, mean_turnover ASC NULLS LAST, dd.candidate_id) AS k FROM dd LEFT JOIN ws ON dd.candidate_id = ws.candidate_id WHERE {guard}) WHERE k = 1", ["score"], ["run_id", "candidate_id"], *_ALL, winner_scores("dd", "decision", "ws"))


_QUALITY = f"0.34 * {_th('quick_rank_icir', 0.35)} + 0.26 * {_th('net_sharpe', 3.0)} + 0.18 * {_th('net_excess_ann_return', 0.35)} + 0.12 * {_th('net_ann_return', 3.0)} + 0.06 * {_up('neutral_quick_rank_icir', 0.2)} + 0.06 * {_up('neutral_net_sharpe', 1.8)} - 0.08 * {_up('mean_turnover', 0.25)} + CASE status WHEN 'research_winner' THEN 0.05 WHEN 'research_keep' THEN 0.02 WHEN 'research_keep_exploratory' THEN 0.01 ELSE 0 END"
_ANCHOR = f"0.32 * {_th('net_excess_ann_return', 0.35)} + 0.24 * {_th('quick_rank_icir', 0.35)} + 0.18 * {_th('net_sharpe', 3.0)} + 0.10 * {_th('quick_rank_ic_mean', 0.08)} + 0.08 * {_th('winner_score', 0.5)} - 0.08 * {_up('mean_turnover', 0.25)} + CASE WHEN status LIKE '%winner%' THEN 0.08 ELSE 0 END"
_REASONS = "array_to_string(list_filter([CASE WHEN status NOT IN ('research_winner', 'research_keep', 'research_keep_exploratory') THEN 'status_not_promotable' END, CASE WHEN 1 - lacks / 4.0 < 0.75 THEN 'metrics_incomplete' END, CASE WHEN coalesce(quick_rank_icir < 0.20, true) THEN 'icir_below_threshold' END, CASE WHEN coalesce(net_sharpe < 1.0, true) THEN 'sharpe_below_threshold' END, CASE WHEN coalesce(mean_turnover > 0.40, true) THEN 'turnover_above_threshold' END], lambda x: x IS NOT NULL), '|')"
#: The family's accepted factors are its winners of the first round.
_ACCEPTED = f"""sr AS ({SERIES_SQL}), fa AS (SELECT a.candidate_id, b.factor_name AS matched, abs(corr(x.value, y.value)) AS family_corr
  FROM c a JOIN c b ON a.family = b.family AND b.status = 'research_winner' AND b.round_id = 1 AND a.factor_name <> b.factor_name
  JOIN sr x ON x.name = a.factor_name JOIN sr y ON y.name = b.factor_name AND x.key = y.key GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_samp(x.value) > 0 AND stddev_samp(y.value) > 0),
fc AS (SELECT candidate_id, matched, family_corr FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY round(family_corr, 9) DESC, matched DESC) AS k FROM fa) WHERE k = 1)"""
_PROMOTED = """p1 AS (SELECT es.*, CASE WHEN role <> 'candidate' THEN 'role' WHEN status NOT IN ('research_winner', 'research_keep') THEN 'decision' WHEN coalesce(expression, '') = '' THEN 'expression' WHEN status = 'research_keep' AND lacks > 0 THEN 'incomplete' WHEN status = 'research_keep' AND mean_turnover > 0.25 THEN 'turnover'
  WHEN status = 'research_keep' AND NOT (coalesce(round(winner_score, 9) >= 0.55, false) OR coalesce(net_ann_return > 0 AND net_sharpe > 0 AND quick_rank_icir > 0, false)) THEN 'quality' WHEN corr_to_nearest_target >= CASE WHEN status = 'research_winner' THEN 0.90 ELSE 0.85 END THEN 'correlation'
  WHEN round(family_corr, 9) >= CASE WHEN status = 'research_winner' THEN 0.90 ELSE 0.85 END THEN 'family_correlation' END AS why FROM es LEFT JOIN fc ON es.candidate_id = fc.candidate_id),
p2 AS (SELECT *, row_number() OVER (PARTITION BY family, status, why IS NULL ORDER BY round(coalesce(winner_score, 0), 9) DESC, coalesce(net_excess_ann_return, 0) DESC, round(coalesce(net_ann_return, 0) + 0.25 * coalesce(net_sharpe, 0), 9) DESC, coalesce(mean_turnover, 0), candidate_id) AS turn FROM p1),
p3 AS (SELECT *, CASE WHEN why IS NULL AND status = 'research_keep' AND turn > 2 THEN 'enough' ELSE why END AS reason_ FROM p2)"""

# search scores
_SAMPLES = [(m, f"{m}", f"coalesce({m}, 0)") for m in METRICS[:5]] + [("mean_turnover", "mean_turnover", "greatest(coalesce(mean_turnover, 0), 0)"), ("complexity", _COMPLEXITY, _COMPLEXITY), ("depth", _DEPTH, f"greatest({_DEPTH} - 1, 0)")]
_BASED = (
    "vals AS (" + " UNION ALL ".join(f"SELECT candidate_id, family, '{n}' AS name, ({v})::DOUBLE AS val FROM e" for n, _, v in _SAMPLES) + ")",
    "smp AS (" + " UNION ALL ".join(f"SELECT family, '{n}' AS name, ({x})::DOUBLE AS val FROM e WHERE {x} IS NOT NULL" for n, x, _ in _SAMPLES) + ")",
    "cn AS (SELECT family, name, count(*) AS n FROM smp GROUP BY 1, 2)",
    "lo AS (SELECT name, list_sort(list(val))[1:40] AS low FROM smp GROUP BY 1)",
    "le AS (SELECT v.candidate_id, v.family, v.name, v.val, count(s.val) AS le FROM vals v LEFT JOIN smp s ON s.family = v.family AND s.name = v.name AND s.val <= v.val GROUP BY 1, 2, 3, 4)",
    "qs AS (SELECT candidate_id, name, CASE WHEN n + x >= 40 THEN (le + least(x, len(list_filter(low, lambda y: y <= val))))::DOUBLE / (n + x) END AS q FROM (SELECT le.*, coalesce(cn.n, 0) AS n, lo.low, greatest(0, least(40 - coalesce(cn.n, 0), len(lo.low))) AS x FROM le LEFT JOIN cn ON le.family = cn.family AND le.name = cn.name LEFT JOIN lo ON le.name = lo.name))",
    "qw AS (SELECT candidate_id, " + ", ".join(f"max(CASE WHEN name = '{n}' THEN q END) AS q_{n}" for n, _, _ in _SAMPLES) + " FROM qs GROUP BY 1)",
    "bd AS (SELECT e.*, "
    + " + ".join(f"{w} * coalesce(2 * q_{m} - 1, {_th(m, s)})" for m, w, s in (("quick_rank_ic_mean", 1.8, 0.08), ("quick_rank_icir", 0.6, 0.6), ("net_ann_return", 0.7, 1.8), ("net_excess_ann_return", 0.6, 1.2), ("net_sharpe", 0.8, 2.0)))
    + f" - 0.35 * coalesce(q_mean_turnover, {_up('mean_turnover', 0.45)}) - 0.05 * coalesce(q_depth, {_up(_DEPTH + ' - 1', 3.0)}) - 0.025 * coalesce(q_complexity, {_up(_COMPLEXITY, 8.0)}) + CASE WHEN status LIKE '%winner%' THEN 0.05 WHEN status LIKE '%keep%' THEN 0.02 ELSE 0 END AS base_score FROM e JOIN qw ON e.candidate_id = qw.candidate_id)",
)
_RISK = r"CASE WHEN NOT (t LIKE '%redundant%' OR t LIKE '%corr%') THEN 0.0::DOUBLE WHEN regexp_extract(t, 'corr[^=]*=\s*([0-9.]+)', 1) <> '' THEN least(greatest(coalesce(try_cast(regexp_extract(t, 'corr[^=]*=\s*([0-9.]+)', 1) AS DOUBLE), 0.5), 0.0), 1.0) ELSE 0.5 END"
_PROFILES = f"ps AS (SELECT family, profile_key, count(*) AS n, avg(CASE WHEN risk > 0 THEN risk END) AS corr_risk FROM (SELECT *, {_RISK} AS risk FROM (SELECT *, lower(concat_ws(' ', status, reason)) AS t FROM pk)) GROUP BY 1, 2)"
_TARGETED = (
    f"tc AS (SELECT e.candidate_id, e.run_id, {_clamp('coalesce(corr_risk, 0)')} AS risk, 1 - {_clamp('n / 6.0::DOUBLE')} AS novel, greatest(n - 1, 0) / 6.0::DOUBLE AS many, "
    + _clamp(f"0.30 * (1 - {_up('mean_turnover', 0.45)}) + 0.20 * (1 - tanh({_COMPLEXITY.replace('expression', 'e.expression')} / 8.0)) + 0.30 * {_clamp('0.75 * (1 - lacks / 4.0::DOUBLE) + 0.25')} + 0.20 * (1 - greatest({_clamp('(n - 1) / 5.0::DOUBLE')}, {_clamp('coalesce(corr_risk, 0)')})) - 0.10 * {_clamp('lacks / 4.0::DOUBLE')}")
    + " AS constraint_ FROM e JOIN pk ON e.candidate_id = pk.candidate_id JOIN ps ON pk.family = ps.family AND pk.profile_key = ps.profile_key)",
    f"tm AS (SELECT a.candidate_id, rf.rank, round({_clamp(f'0.25 * ' + _eq('profile_key') + ' + 0.20 * ' + _eq('oskel') + ' + 0.15 * ' + _eq('motif') + ' + 0.10 * ' + _eq('mutation') + ' + 0.15 * (' + _jac('tags') + ') + 0.15 * (' + _jac('words') + ')')}, 9) AS alike, "
    + _clamp(f"0.35 * (1 - {_eq('oskel')}) + 0.20 * (1 - {_eq('motif')}) + 0.20 * (1 - {_eq('mutation')}) + 0.25 * (1 - ({_jac('tags')}))")
    + " AS unlike FROM pk a JOIN rf ON a.run_id = rf.run_id AND a.candidate_id <> rf.candidate_id JOIN pk b ON rf.candidate_id = b.candidate_id)",
    "tb AS (SELECT candidate_id, max(alike) AS most, avg(alike) AS mean, arg_max(unlike, row(alike, -rank)) AS unlike FROM tm GROUP BY 1)",
    f"tp AS (SELECT tc.candidate_id, constraint_, most, mean, CASE WHEN most IS NULL THEN {_clamp('0.70 + 0.30 * novel - 0.10 * risk')} ELSE {_clamp('0.50 * (1 - most) + 0.15 * (1 - mean) + 0.25 * unlike + 0.10 * novel - 0.20 * ' + _clamp('(most - 0.35) / 0.45') + ' - 0.10 * ' + _clamp('0.60 * risk + 0.40 * many'))} END AS portfolio FROM tc LEFT JOIN tb ON tc.candidate_id = tb.candidate_id)",
)


def _d(m: str) -> str:
    return f"(coalesce({m}, 0) - coalesce(p_{m}, 0))"


_GAIN = f"gn AS (SELECT *, greatest(least(0.35 * tanh({_d('net_sharpe')} / 1.5::DOUBLE) + 0.25 * tanh({_d('net_excess_ann_return')} / 0.5::DOUBLE) + 0.20 * tanh({_d('net_ann_return')}) + 0.10 * tanh({_d('quick_rank_icir')} / 0.3::DOUBLE) + 0.10 * tanh({_d('quick_rank_ic_mean')} / 0.05::DOUBLE) - 0.15 * tanh(greatest({_d('mean_turnover')}, 0) / 0.15::DOUBLE), 1.0), -1.0) AS gain FROM wp WHERE p_id IS NOT NULL)"
_CHILDREN = (
    _PARENT, _GAIN, _PROFILE,
    f"ch AS (SELECT g.* EXCLUDE (gain), round(g.gain, 12) AS gain, a.motif, a.mutation, b.motif AS pm, {ALIKE} AS alike, status IN ('research_winner', 'research_keep', 'research_keep_exploratory') AS kept_, coalesce(net_excess_ann_return > 0, false) AS ex, coalesce(mean_turnover <= coalesce(least(greatest(p_mean_turnover * 1.10, 0.12), 0.30), 0.20), false) AS cheap FROM (SELECT candidate_id AS cid, * FROM gn) g JOIN pf a ON g.cid = a.candidate_id JOIN pf b ON g.p_id = b.candidate_id)".replace("status IN", "g.status IN"),
    "cs AS (SELECT parent_candidate_id, count(*) AS total, count(CASE WHEN kept_ THEN 1 END) AS kept, count(CASE WHEN status = 'research_winner' THEN 1 END) AS won, greatest(max(gain), 0.0) AS best, avg(CASE WHEN r <= 3 THEN gain END) AS top3, quantile_cont(gain, 0.5) AS median, avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS positive, CASE WHEN count(*) > 1 THEN stddev_pop(gain) ELSE 0 END AS spread, count(DISTINCT source_model) AS models, count(DISTINCT mutation) AS mutations, avg(ex::INT) AS excess_rate, avg(cheap::INT) AS cheap_rate, avg((lacks = 0)::INT) AS full_rate, avg((ex AND cheap AND lacks = 0)::INT) AS friendly_rate, count(CASE WHEN gain > 0.15 AND round(alike, 9) < 0.65 AND kept_ THEN 1 END) AS novel, count(CASE WHEN motif <> pm THEN 1 END) AS others, count(CASE WHEN motif <> pm AND kept_ THEN 1 END) AS others_kept, greatest(max(p_round), max(round_id)) AS now_, max(CASE WHEN kept_ OR gain > 0 THEN round_id END) AS success FROM (SELECT *, row_number() OVER (PARTITION BY parent_candidate_id ORDER BY gain DESC, candidate_id) AS r FROM ch) GROUP BY 1)",
    "su AS (SELECT parent_candidate_id, max(m) AS support FROM (SELECT parent_candidate_id, motif, count(DISTINCT source_model) AS m FROM ch GROUP BY 1, 2) GROUP BY 1)",
)
_UNIT = lambda x: f"least(greatest(({x} + 1) / 2, 0.0), 1.0)"
_EXPAND = f"SELECT parent_candidate_id, total, (0.35 * (kept + 1) / (total + 3)::DOUBLE + 0.25 * (won + 1) / (total + 4)::DOUBLE + 0.20 * {_UNIT('best')} + 0.10 * least(models / 3.0::DOUBLE, 1.0) + 0.10 * least(mutations / 4.0::DOUBLE, 1.0)) * least(total / 8.0::DOUBLE, 1.0) AS expandability FROM cs"
_BRANCH = f"""SELECT *, least(total / 10.0::DOUBLE, 1.0) * recency * (0.35 * gain + 0.25 * stability + 0.25 * admission + 0.15 * novelty) AS branch FROM (SELECT cs.parent_candidate_id, total, 0.35 * {_UNIT('best')} + 0.30 * {_UNIT('top3')} + 0.20 * {_UNIT('median')} + 0.15 * positive AS gain,
  0.35 * least(models / 3.0::DOUBLE, 1.0) + 0.35 * CASE WHEN models > 1 THEN least(greatest((support - 1)::DOUBLE / (models - 1), 0), 1) ELSE 0 END + 0.30 * (1 - least(spread / 0.6, 1.0)) AS stability, 0.30 * excess_rate + 0.20 * cheap_rate + 0.20 * full_rate + 0.30 * friendly_rate AS admission,
  0.35 * least(novel / 3.0::DOUBLE, 1.0) + 0.35 * CASE WHEN others > 0 THEN others_kept::DOUBLE / others ELSE 0 END + 0.30 * least(mutations / 4.0::DOUBLE, 1.0) AS novelty, greatest(0.4, 1 - 0.12 * CASE WHEN success > 0 THEN greatest(now_ - success, 0) ELSE 0 END) AS recency FROM cs JOIN su ON cs.parent_candidate_id = su.parent_candidate_id)"""
_FRONTIER = "fr AS (SELECT bd.candidate_id, bd.family, bd.base_score, bd.parent_candidate_id, pf.motif, pf.mutation, pf.oskel, pf.tags, pf.calls, pf.words, pf.branch FROM bd JOIN pf ON bd.candidate_id = pf.candidate_id)"
_ORDER = "round(base_score, 9) DESC, candidate_id"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "metrics_completeness": (lambda s, d: shown(D.completeness(evaluated(s, d))), _sql("SELECT candidate_id, 1 - lacks / 4.0::DOUBLE AS completeness, lacks AS n_missing FROM e", ["completeness"], ["candidate_id", "n_missing"])),
    "metric_gap_retention": (
        lambda s, d: shown(D.gaps(evaluated(s, d))),
        _sql("SELECT candidate_id, " + ", ".join(f"{m} - neutral_{m} AS {m}_gap, {_ret(m)} AS {m}_retention" for m in ("quick_rank_icir", "net_sharpe")) + " FROM e", ["quick_rank_icir_gap", "quick_rank_icir_retention", "net_sharpe_gap", "net_sharpe_retention"], ["candidate_id"]),
    ),
    "neutral_guard": (lambda s, d: D.neutral_guard(evaluated(s, d)), f"WITH {_BASE} SELECT candidate_id, {_GUARD} AS passes FROM e"),
    "material_gain": (lambda s, d: D.material_gain(evaluated(s, d)), f"WITH {_BASE}, {_PARENT} SELECT candidate_id, {_MATERIAL} AS material, array_to_string({_BROAD}, '|') AS broad FROM wp WHERE p_id IS NOT NULL"),
    "quality_floor": (lambda s, d: D.quality_floor(evaluated(s, d)), f"WITH {_BASE} SELECT candidate_id, {_FLOOR} AS passes FROM e"),
    "exploration_score": (lambda s, d: shown(D.exploration_score(evaluated(s, d))), _sql("SELECT candidate_id, exploration AS score FROM xq", ["score"], ["candidate_id"], _PROFILE, _REFS, _NOVEL)),
    "decorrelation_assessment": (lambda s, d: shown(D.decorrelation_assessment(evaluated(s, d))), _sql("SELECT candidate_id, grade, dscore AS score, adjustment, gate AS action FROM asd", ["score", "adjustment"], ["candidate_id", "grade", "action"], _PARENT, _ASSESSED)),
    "candidate_decision": (lambda s, d: D.candidate_decision(evaluated(s, d)), _sql("SELECT * FROM dd", [], ["candidate_id", "decision", "why"], *_ALL)),
    "exploratory_keep": (lambda s, d: D.decided(evaluated(s, d)).where("why = 'explores'").select("candidate_id", "run_id", "decision"), _sql("SELECT * FROM dd WHERE why = 'explores'", [], ["candidate_id", "run_id", "decision"], *_ALL)),
    "winner_score": (lambda s, d: shown(D.winner_score(evaluated(s, d))), _sql("SELECT candidate_id, run_id, winner_score AS score FROM ws", ["score"], ["candidate_id", "run_id"], winner_scores("e", "status", "ws"))),
    "keep_floor": (lambda s, d: D.keep_floor(evaluated(s, d)), _sql("SELECT candidate_id, run_id, CASE WHEN n_kept = 0 AND usable AND k = 1 THEN 'research_keep' ELSE decision END AS decision FROM fk", [], ["candidate_id", "run_id", "decision"], *_ALL, _FLOORED)),
    "assign_winner": (lambda s, d: shown(D.assign_winner(evaluated(s, d))), _winner(_STANDARD, ["winner_score", "net_sharpe", "net_excess_ann_return", "net_ann_return", "quick_rank_icir", "quick_rank_ic_mean"])),
    "assign_winner_broad": (lambda s, d: shown(D.assign_winner(evaluated(s, d), True)), _winner(_BROADLY, ["net_sharpe", "net_ann_return", "net_excess_ann_return", "quick_rank_icir", "neutral_net_sharpe", "neutral_quick_rank_icir", "winner_score"])),
    "ranked_summary": (lambda s, d: shown(D.ranked_summary(evaluated(s, d))), _sql("SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY quick_rank_icir DESC NULLS LAST, net_ann_return DESC NULLS LAST, quick_rank_ic_mean DESC NULLS LAST, candidate_id)::INT AS rank FROM e", ["quick_rank_icir", "net_ann_return"], ["run_id", "rank", "candidate_id"])),
    "promotion_gate": (lambda s, d: _promoted(s, d), _sql("SELECT candidate_id, family, reason_ IS NULL AS promoted, coalesce(reason_, 'passed') AS why FROM p3", [], ["candidate_id", "family", "promoted", "why"], _SCORED, _ACCEPTED, _PROMOTED)),
    "promotion_family_correlation": (lambda s, d: shown(_family_corr(s, d)), _sql("SELECT * FROM fc", ["family_corr"], ["candidate_id", "matched"], _ACCEPTED)),
    "rerank_score": (lambda s, d: shown(D.reranked(evaluated(s, d))), _sql(f"SELECT candidate_id, {_QUALITY} AS quality, adjustment, {_QUALITY} + adjustment AS score FROM asd", ["quality", "adjustment", "score"], ["candidate_id"], _PARENT, _ASSESSED)),
    "select_anchor": (
        lambda s, d: shown(D.select_anchor(evaluated(s, d))),
        _sql("SELECT candidate_id, family, reasons, quality, reasons = '' AND k = 1 AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY family, reasons = '' ORDER BY round(quality, 9) DESC, net_excess_ann_return DESC NULLS LAST, quick_rank_icir DESC NULLS LAST, net_sharpe DESC NULLS LAST, candidate_id) AS k FROM an)", ["quality"], ["candidate_id", "family", "reasons", "anchor"], _SCORED, f"an AS (SELECT *, {_REASONS} AS reasons, {_ANCHOR} AS quality FROM es)"),
    ),
    "base_score": (lambda s, d: shown(D.base_score(evaluated(s, d))), _sql("SELECT candidate_id, base_score AS score FROM bd", ["score"], ["candidate_id"], *_BASED)),
    "metric_normaliser": (
        lambda s, d: shown(_percentiles(s, d)),
        _sql("SELECT candidate_id, q_net_sharpe AS net_sharpe_pct, q_quick_rank_icir AS quick_rank_icir_pct, q_mean_turnover AS mean_turnover_pct FROM qw", ["net_sharpe_pct", "quick_rank_icir_pct", "mean_turnover_pct"], ["candidate_id"], *_BASED[:-1]),
    ),
    "profile_stats": (lambda s, d: shown(D.profile_stats(C.profiled(evaluated(s, d)))), _sql("SELECT * FROM ps", ["corr_risk"], ["family", "profile_key", "n"], _PROFILE, _PROFILES)),
    "target_score": (
        lambda s, d: shown(D.target_scores(evaluated(s, d)).withColumnRenamed("constraint", "constraint_score")),
        _sql("SELECT candidate_id, constraint_ AS constraint_score, most AS most_alike, mean AS mean_alike, portfolio, 0.24 * (0.25 * constraint_ + 0.85 * portfolio) AS target FROM tp", ["constraint_score", "most_alike", "mean_alike", "portfolio", "target"], ["candidate_id"], _PROFILE, _REFS, _PROFILES, *_TARGETED),
    ),
    "parent_child_gain": (lambda s, d: shown(D.parent_child_gain(evaluated(s, d))), _sql("SELECT * FROM gn", ["gain"], ["candidate_id", "parent_candidate_id"], _PARENT, _GAIN)),
    "expandability": (lambda s, d: shown(D.expandability(evaluated(s, d))), _sql(_EXPAND, ["expandability"], ["parent_candidate_id", "total"], *_CHILDREN)),
    "branch_value": (lambda s, d: shown(D.branch_value(evaluated(s, d))), _sql(_BRANCH, ["gain", "stability", "admission", "novelty", "branch"], ["parent_candidate_id"], *_CHILDREN)),
    "pair_similarity": (
        lambda s, d: shown(_pairs(s, d)),
        _sql(
            f"SELECT a.candidate_id AS a, b.candidate_id AS b, {ALIKE} AS similarity FROM (SELECT a, b FROM pp UNION SELECT parent_candidate_id, candidate_id FROM fr WHERE parent_candidate_id IS NOT NULL) x JOIN fr a ON x.a = a.candidate_id JOIN fr b ON x.b = b.candidate_id", ["similarity"], ["a", "b"], *_BASED, _PROFILE, _FRONTIER,
            f"pl AS (SELECT family, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_ORDER}) AS k FROM fr) WHERE k <= 8), pp AS (SELECT x.candidate_id AS a, y.candidate_id AS b FROM pl x JOIN pl y ON x.family = y.family AND x.candidate_id < y.candidate_id)",
        ),
    ),
    "capped_top_k": (
        lambda s, d: shown(D.capped_top_k(evaluated(s, d))),
        _sql(f"SELECT family, rank, candidate_id, base_score AS score FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_ORDER})::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY family, branch ORDER BY {_ORDER}) AS i, row_number() OVER (PARTITION BY family, motif ORDER BY {_ORDER}) AS j FROM fr) WHERE i <= 2 AND j <= 3) WHERE rank <= 6", ["score"], ["family", "rank", "candidate_id"], *_BASED, _PROFILE, _FRONTIER),
    ),
    "mmr_select": (lambda s, d: D.mmr_select(D.frontier(evaluated(s, d))), None),
}


def _family_corr(s: SparkSession, d: str) -> DataFrame:
    rows = candidates(s, d)
    return D.nearest_accepted(rows, rows.where("status = 'research_winner' and round_id = 1"), series(s, d))


def _promoted(s: SparkSession, d: str) -> DataFrame:
    return D.promotions(evaluated(s, d), family=_family_corr(s, d))


def _percentiles(s, d):
    from pyspark.sql import functions as F

    zero = F.lit(0.0)
    values = {f"{m}_pct": (F.col(m), F.coalesce(m, zero)) for m in ("net_sharpe", "quick_rank_icir")} | {"mean_turnover_pct": (F.col("mean_turnover"), F.greatest(F.coalesce("mean_turnover", zero), zero))}
    return D.metric_percentiles(evaluated(s, d), values).select("candidate_id", *values)


def _mmr_sql(n: int = 5) -> str:
    """The greedy pass written out, one table a step."""
    steps = [
        f"pl AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_ORDER}) AS k FROM fr)",
        "pn AS (SELECT *, (base_score - min(base_score) OVER (PARTITION BY family)) / greatest(max(base_score) OVER (PARTITION BY family) - min(base_score) OVER (PARTITION BY family), 1e-12) AS rel FROM pl)",
        f"sm AS (SELECT a.family, a.candidate_id AS a, b.candidate_id AS b, {ALIKE} AS s FROM pn a JOIN pn b ON a.family = b.family AND a.candidate_id <> b.candidate_id)",
        "k0 AS (SELECT NULL::VARCHAR AS family, -1 AS position, NULL::BIGINT AS candidate_id WHERE false)",
    ]
    for i in range(n):
        steps.append(
            f"k{i + 1} AS (SELECT * FROM k{i} UNION ALL SELECT family, {i}, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY value DESC, k) AS r FROM (SELECT p.family, p.candidate_id, p.k, round(0.72::DOUBLE * any_value(p.rel) - (1 - 0.72)::DOUBLE * coalesce(max(sm.s), 0), 9) AS value FROM pn p LEFT JOIN k{i} c ON c.family = p.family LEFT JOIN sm ON sm.a = p.candidate_id AND sm.b = c.candidate_id WHERE p.candidate_id NOT IN (SELECT candidate_id FROM k{i}) GROUP BY 1, 2, 3)) WHERE r = 1)"
        )
    return _sql(f"SELECT * FROM k{n}", [], ["family", "position", "candidate_id"], *_BASED, _PROFILE, _FRONTIER, *steps)


QUERIES["mmr_select"] = (QUERIES["mmr_select"][0], _mmr_sql())


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
