"""Gates, decisions, ranking and search scores of candidates: conditions over metrics, and joins between candidates.

A run's candidates are judged against their parents. Metrics that are missing are null; a condition on one is false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators.archive import KEEP, WINNER, reference_candidates, top_n
from quantloom.operators.candidates import compared, complexity, depth, jaccard, keywords, likeness, profiled
from quantloom.operators.moments import nearest_series
from quantloom.sources.shared import Tables

EXPLORATORY = "research_keep_exploratory"
KEPT = (WINNER, KEEP, EXPLORATORY)
# Metrics, weights, thresholds and scales.
METRICS = ("quick_rank_ic_mean", "quick_rank_icir", "net_ann_return", "net_excess_ann_return", "net_sharpe", "mean_turnover")
CORE = ("net_ann_return", "net_excess_ann_return", "net_sharpe", "mean_turnover")
WINNER_WEIGHTS = {"quick_rank_ic_mean": 0.14, "quick_rank_icir": 0.16, "net_ann_return": 0.18, "net_excess_ann_return": 0.18, "net_sharpe": 0.26, "mean_turnover": 0.08}
MATERIAL = {"net_excess_ann_return": 0.02, "quick_rank_icir": 0.05, "net_sharpe": 0.25}
BROAD_MATERIAL = {"quick_rank_icir": 0.02, "net_ann_return": 0.20, "net_excess_ann_return": 0.05}
GRADES = ((0.35, "excellent", 0.12), (0.55, "good", 0.08), (0.70, "acceptable", 0.03), (0.85, "weak", -0.12))
FAILED_PENALTY, MEAN_PENALTY, ACCEPTABLE = 0.24, 0.08, 0.70
SUPPRESS, SOFT_DROP, HARD_DROP = 0.75, 0.85, 0.90

c = F.col


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _tanh(x: Column | str, scale: float) -> Column:
    return F.tanh(F.coalesce(c(x) if isinstance(x, str) else x, F.lit(0.0)) / scale)


def _up(x: Column | str, scale: float) -> Column:
    return F.tanh(F.greatest(F.coalesce(c(x) if isinstance(x, str) else x, F.lit(0.0)), F.lit(0.0)) / scale)


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def with_parent(df: DataFrame, columns: Sequence[str] = (*METRICS, "expression")) -> DataFrame:
    """df with p_id and the parent's columns as p_*; null without a parent."""
    p = df.select(c("candidate_id").alias("p_id"), *[c(m).alias(f"p_{m}") for m in columns])
    return df.join(p, c("parent_candidate_id") == c("p_id"), "left")


# --- conditions ----------------------------------------------------------------------------------------------


def missing_core() -> Column:
    return sum((F.when(c(m).isNull(), 1).otherwise(0) for m in CORE), F.lit(0))


def completeness(df: DataFrame) -> DataFrame:
    """Share of the core metrics that are present, and the number missing."""
    return df.select("candidate_id", (1 - missing_core() / len(CORE)).alias("completeness"), missing_core().alias("n_missing"))


def retention(raw: str, neutral: str) -> Column:
    return F.when(F.abs(raw) > 1e-12, c(neutral) / c(raw))


def gaps(df: DataFrame) -> DataFrame:
    """Raw less neutral, and neutral over raw (where raw is not 0), of each metric."""
    out = []
    for m in ("quick_rank_icir", "net_sharpe"):
        out += [(c(m) - c(f"neutral_{m}")).alias(f"{m}_gap"), retention(m, f"neutral_{m}").alias(f"{m}_retention")]
    return df.select("candidate_id", *out)


def passes_neutral_guard() -> Column:
    """False only if a candidate follows the styles and both its icir and sharpe, positive when raw, collapse when neutral."""

    def collapsed(m: str) -> Column:
        return _true((c(m) > 0) & (c(f"neutral_{m}") <= 0) & F.coalesce(retention(m, f"neutral_{m}") < 0.25, F.lit(True)))

    return ~((c("role") == "candidate") & _true(c("avg_abs_style_corr") >= 0.20) & collapsed("quick_rank_icir") & collapsed("net_sharpe"))


def neutral_guard(df: DataFrame) -> DataFrame:
    return df.select("candidate_id", passes_neutral_guard().alias("passes"))


def _gain(m: str) -> Column:
    return c(m) - c(f"p_{m}")


def gains_materially() -> Column:
    out = F.lit(False)
    for m, least in MATERIAL.items():
        out = out | _true(_gain(m) >= least)
    return out


def material_gain(df: DataFrame) -> DataFrame:
    """Whether a candidate gains materially on its parent, and in broad mode which metrics do (joined by a bar)."""
    broad = F.concat_ws("|", *[F.when(_gain(m) >= least, F.lit(m)) for m, least in BROAD_MATERIAL.items()])
    return with_parent(df).where("p_id IS NOT NULL").select("candidate_id", gains_materially().alias("material"), broad.alias("broad"))


def passes_quality_floor() -> Column:
    return _true(c("quick_rank_icir") >= 0.30) | _true((c("quick_rank_ic_mean") >= 0.03) & (c("net_sharpe") >= 0))


def quality_floor(df: DataFrame) -> DataFrame:
    return df.select("candidate_id", passes_quality_floor().alias("passes"))


# --- decorrelation -------------------------------------------------------------------------------------------


def assessed(df: DataFrame, strong: bool = True) -> DataFrame:
    """df (with parents) and grade, decorrelation_score, adjustment, gate_action, winner_allowed, keep_allowed, reference_allowed.

    By the greatest absolute correlation with a target (the mean one where that is missing) and the quality of the
    candidate. strong: whether gates act, as they do where targets are given.
    """
    near = F.coalesce(F.abs("corr_to_nearest_target"), c("avg_abs_target_corr"))
    mean = c("avg_abs_target_corr")
    good = (
        _true((c("quick_rank_icir") >= 0.15) & (c("net_sharpe") >= 1.20))
        | _true(c("net_excess_ann_return") >= 0.05)
        | _true(c("net_ann_return") >= 1.50)
        | _true((c("neutral_quick_rank_icir") >= 0.08) & (c("neutral_net_sharpe") >= 1.0))
    )
    best = _true((c("quick_rank_icir") >= 0.50) & (c("net_sharpe") >= 3.00))
    d = df.withColumns({"_near": near, "_good": good, "_best": best, "_gains": gains_materially()})
    near, good, best, gains = c("_near"), c("_good"), c("_best"), c("_gains")
    grade, bonus = F.lit("failed"), F.lit(-FAILED_PENALTY)
    for upto, name, value in reversed(GRADES):
        grade = F.when(near <= upto, name).otherwise(grade)
        bonus = F.when(near <= upto, F.when(good, value).otherwise(0.0) if value > 0 else F.lit(value)).otherwise(bonus)
    over = F.when(_true(mean > ACCEPTABLE), MEAN_PENALTY * _clamp((mean - ACCEPTABLE) / (1 - ACCEPTABLE))).otherwise(0.0)
    score = F.when(mean.isNotNull(), 0.75 * (1 - near) + 0.25 * (1 - F.abs(mean))).otherwise(1 - near)
    action = (
        F.when(near > HARD_DROP, F.when(best | gains, "suppress_high_corr_reference").otherwise("drop"))
        .when((near > SOFT_DROP) & ~gains, "drop")
        .when((near > SUPPRESS) & ~best, "suppress_winner")
        .when(near > ACCEPTABLE, "soft_penalty")
        .otherwise("pass")
    )
    none = near.isNull()
    d = d.withColumns({
        "grade": F.when(none, "unknown").otherwise(grade),
        "decorrelation_score": F.when(none, 0.0).otherwise(F.round(_clamp(score), 4)),
        "adjustment": F.when(none, 0.0).otherwise(F.round(bonus - over, 4)),
        "gate_action": F.when(none | F.lit(not strong), "pass").otherwise(action),
    })
    a = c("gate_action")
    return d.withColumns({"winner_allowed": a.isin("pass", "soft_penalty"), "keep_allowed": ~a.isin("drop", "suppress_high_corr_reference"), "reference_allowed": a == "suppress_high_corr_reference"}).drop("_near", "_good", "_best", "_gains")


def decorrelation_assessment(df: DataFrame) -> DataFrame:
    return assessed(with_parent(df)).select("candidate_id", "grade", c("decorrelation_score").alias("score"), "adjustment", c("gate_action").alias("action"))


# --- exploration and decisions -------------------------------------------------------------------------------


def explored(df: DataFrame) -> DataFrame:
    """df (profiled) with exploration: new mutation .35, motif .30 and model .25 against the family's references, .10 for a low correlation.

    References are the eight newest kept candidates of the family's other runs, and the parent (motif and model).
    """
    refs = reference_candidates(df).join(df.select("candidate_id", c("shape").alias("_shape"), c("motif").alias("_motif"), c("source_model").alias("_model")), "candidate_id")
    sets = refs.groupBy("run_id").agg(*[F.collect_set(x).alias(f"{x}s") for x in ("_shape", "_motif", "_model")])
    parents = df.select(c("candidate_id").alias("_pid"), c("motif").alias("_pmotif"), c("source_model").alias("_pmodel"))
    j = df.join(sets, "run_id", "left").join(parents, c("parent_candidate_id") == c("_pid"), "left")

    def new(value: str, seen: str, parent: str | None) -> Column:
        known = _true(F.array_contains(seen, c(value)))
        known = known | _true(c(value) == c(parent)) if parent else known
        return F.when(known | (F.coalesce(c(value), F.lit("")) == ""), 0.0).otherwise(1.0)

    apart = F.greatest(F.lit(0.0), 1 - F.abs(F.coalesce("corr_to_nearest_target", F.lit(0.0))))
    s = 0.35 * new("mutation", "_shapes", None) + 0.30 * new("motif", "_motifs", "_pmotif") + 0.25 * new("source_model", "_models", "_pmodel") + 0.10 * apart
    return j.withColumn("exploration", s).drop("_shapes", "_motifs", "_models", "_pid", "_pmotif", "_pmodel")


def exploration_score(df: DataFrame) -> DataFrame:
    return explored(profiled(df)).select("candidate_id", c("exploration").alias("score"))


def decided(df: DataFrame, budget: int = 2) -> DataFrame:
    """df with parents, gates, decision and why.

    A candidate with a usable parent and metrics is kept if it improves on a metric at a bearable turnover. Of a
    run's others, the first `budget` (by id) that pass the quality floor with an exploration of 0.5 or more are
    kept to explore; an exact duplicate is always dropped.
    """
    j = assessed(with_parent(explored(profiled(df))))
    improved = F.array_compact(F.array(*[F.when(c(m) > c(f"p_{m}"), F.lit(m)) for m in METRICS[:5]]))
    has = lambda m: F.array_contains("_improved", m)
    turnover, before = c("mean_turnover"), c("p_mean_turnover")
    bearable = before.isNull() | turnover.isNull() | _true(turnover <= F.greatest(before * 2, F.lit(0.50)))
    close = before.isNull() | turnover.isNull() | _true(turnover <= before * 1.25)
    keeps = (bearable & (F.size("_improved") > 0)) | (has("quick_rank_ic_mean") & has("net_ann_return")) | ((has("net_excess_ann_return") | has("net_sharpe")) & close)
    no_baseline = c("p_id").isNull() | F.coalesce(*[c(f"p_{m}") for m in METRICS]).isNull()
    stage = (
        F.when(c("status") == "drop_redundant_family_exact", "exact_duplicate")
        .when(c("role") != "candidate", "baseline")
        .when(no_baseline, "missing_parent")
        .when(F.trim("expression") == F.trim("p_expression"), "same_expression")
        .when(missing_core() > 1, "incomplete")
        .when(c("net_sharpe").isNull() & c("mean_turnover").isNull(), "incomplete")
        .when(c("gate_action").isin("drop", "suppress_high_corr_reference"), "correlated")
        .when(c("_keeps"), "improves")
        .when(passes_quality_floor() & (F.round("exploration", 9) >= 0.50), "explores")
        .otherwise(F.when(F.size("_improved") > 0, "trade_off").otherwise("no_gain"))
    )
    j = j.withColumn("_improved", improved).withColumn("_keeps", keeps).withColumn("_stage", stage)
    turn = F.row_number().over(Window.partitionBy("run_id", "_stage").orderBy("candidate_id"))
    j = j.withColumn("_turn", turn)
    why = F.when((c("_stage") == "explores") & (c("_turn") > budget), F.when(F.size("_improved") > 0, "trade_off").otherwise("no_gain")).otherwise(c("_stage"))
    soft = c("status").startswith("drop_redundant")
    decision = (
        F.when(c("why") == "exact_duplicate", c("status"))
        .when(c("why") == "baseline", c("role"))
        .when(c("why") == "improves", KEEP)
        .when(c("why") == "explores", EXPLORATORY)
        .when(soft & c("why").isin("trade_off", "no_gain"), c("status"))
        .otherwise("research_drop")
    )
    return j.withColumn("why", why).withColumn("decision", decision).drop("_improved", "_keeps", "_stage", "_turn")


def candidate_decision(df: DataFrame) -> DataFrame:
    return decided(df).select("candidate_id", "decision", "why")


def scored(df: DataFrame, decision: str = "status", group: str = "run_id") -> DataFrame:
    """df with winner_score of the kept candidates of each group; null for the others.

    Each metric's score is (average rank - 1) / (n - 1) among the kept ones that have it (1 for a single one),
    turnover inverted, missing 0; weighted.
    """
    kept = _true(c(decision).isin(*KEPT) & (c("role") == "candidate"))
    d, total = df.withColumn("_kept", kept), F.lit(0.0)
    for m, weight in WINNER_WEIGHTS.items():
        by = Window.partitionBy(group, "_kept", c(m).isNull())
        rank = F.rank().over(by.orderBy(m)) + (F.count("*").over(Window.partitionBy(group, "_kept", m)) - 1) / 2
        n = F.count("*").over(by)
        share = (rank - 1) / (n - 1)
        share = F.when(n > 1, 1 - share if m == "mean_turnover" else share).otherwise(1.0)
        total = total + weight * F.when(c(m).isNull(), 0.0).otherwise(share)
    return d.withColumn("winner_score", F.when(c("_kept"), total)).drop("_kept")


def winner_score(df: DataFrame) -> DataFrame:
    s = scored(df)
    return s.where("winner_score IS NOT NULL").select("candidate_id", "run_id", c("winner_score").alias("score"))


def floored(df: DataFrame) -> DataFrame:
    """df (decided): in a run that keeps nothing, the best candidate that no gate or duplicate rules out becomes a keep."""
    run = Window.partitionBy("run_id")
    any_kept = F.max(F.when(c("decision").isin(*KEPT), 1).otherwise(0)).over(run)
    usable = (c("role") == "candidate") & ~c("decision").startswith("drop_redundant") & c("keep_allowed") & (c("why") != "incomplete")
    keys = [F.asc(missing_core()), *[F.desc_nulls_last(m) for m in ("net_sharpe", "net_ann_return", "net_excess_ann_return", "quick_rank_icir", "quick_rank_ic_mean")], F.asc_nulls_last("mean_turnover"), F.asc("candidate_id")]
    d = df.withColumn("_any", any_kept).withColumn("_usable", usable)
    d = d.withColumn("_first", F.row_number().over(Window.partitionBy("run_id", "_usable").orderBy(*keys)))
    rescued = (c("_any") == 0) & c("_usable") & (c("_first") == 1)
    return d.withColumn("decision", F.when(rescued, KEEP).otherwise(c("decision"))).drop("_any", "_usable", "_first")


def keep_floor(df: DataFrame) -> DataFrame:
    return floored(decided(df)).select("candidate_id", "run_id", "decision")


def with_winners(df: DataFrame, broad: bool = False) -> DataFrame:
    """df (decided) with winner_score and decision: each run's best keep that passes the guards is its winner.

    Guards: all core metrics, the neutral guard, no gate against winners, and in broad mode a gain in sharpe and a
    material one, else icir, sharpe and turnover of a standard.
    """
    d = scored(df, "decision")
    material = F.lit(False)
    for m, least in BROAD_MATERIAL.items():
        material = material | _true(_gain(m) >= least)
    if broad:
        guard = _true(_gain("net_sharpe") > 0) & material
        keys = ["net_sharpe", "net_ann_return", "net_excess_ann_return", "quick_rank_icir", "neutral_net_sharpe", "neutral_quick_rank_icir", "winner_score"]
    else:
        guard = _true(c("quick_rank_icir") >= 0.30) & _true(c("net_sharpe") >= 1.5) & _true(c("mean_turnover") <= 0.70)
        keys = ["winner_score", "net_sharpe", "net_excess_ann_return", "net_ann_return", "quick_rank_icir", "quick_rank_ic_mean"]
    ok = (c("role") == "candidate") & (c("decision") == KEEP) & (missing_core() == 0) & passes_neutral_guard() & c("winner_allowed") & guard
    order = [F.desc_nulls_last(F.round(k, 9) if k == "winner_score" else k) for k in keys] + [F.asc_nulls_last("mean_turnover"), F.asc("candidate_id")]
    d = d.withColumn("_ok", ok).withColumn("_first", F.row_number().over(Window.partitionBy("run_id", "_ok").orderBy(*order)))
    return d.withColumn("decision", F.when(c("_ok") & (c("_first") == 1), WINNER).otherwise(c("decision"))).drop("_ok", "_first")


def assign_winner(df: DataFrame, broad: bool = False) -> DataFrame:
    """run_id, candidate_id, score of each run's winner."""
    return with_winners(decided(df), broad).where(c("decision") == WINNER).select("run_id", "candidate_id", c("winner_score").alias("score"))


def ranked_summary(df: DataFrame) -> DataFrame:
    """Each run's candidates by icir, annual return and mean coefficient, missing last."""
    order = [F.desc_nulls_last(m) for m in ("quick_rank_icir", "net_ann_return", "quick_rank_ic_mean")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(*order, "candidate_id"))).select("run_id", "rank", "candidate_id", "quick_rank_icir", "net_ann_return")


def nearest_accepted(df: DataFrame, accepted: DataFrame, series: DataFrame, least: int = 5) -> DataFrame:
    """candidate_id, matched, family_corr: of the family's accepted factors, the one that a candidate's values correlate with most, by absolute value.

    df: candidate_id, family, factor_name; accepted: family, factor_name; series: name, key, value of all of them. A
    factor isn't compared with itself; candidates whose correlations are all missing have no row.
    """
    named = lambda rows: rows.select(c("family").alias("group"), c("factor_name").alias("name"))
    found = nearest_series(series, named(df), named(accepted), least).select("group", c("name").alias("_name"), "matched", c("corr").alias("family_corr"))
    met = df.select("candidate_id", "family", "factor_name").join(found, (c("family") == c("group")) & (c("factor_name") == c("_name")))
    first = F.max_by(F.struct("matched", "family_corr"), F.struct(F.round("family_corr", 9), "matched"))
    return met.groupBy("candidate_id").agg(first.alias("x")).select("candidate_id", "x.*")


def promotions(df: DataFrame, most: int = 2, family: DataFrame | None = None) -> DataFrame:
    """candidate_id, promoted, why of each candidate; at most `most` keeps a family are promoted, by priority.

    A keep needs all metrics, a turnover of at most 0.25, and a winner score of 0.55 or a positive annual return,
    sharpe and icir; a winner's correlation with the nearest target must be below 0.90, a keep's below 0.85, and so
    must be its absolute correlation with the family's accepted factors (family: candidate_id, family_corr).
    """
    d = scored(df)
    d = d.withColumn("family_corr", F.lit(None).cast("double")) if family is None else d.join(family.select(c("candidate_id").alias("_id"), "family_corr"), c("candidate_id") == c("_id"), "left").drop("_id")
    quality = _true(F.round("winner_score", 9) >= 0.55) | _true((c("net_ann_return") > 0) & (c("net_sharpe") > 0) & (c("quick_rank_icir") > 0))
    limit = F.when(c("status") == WINNER, 0.90).otherwise(0.85)
    keep = c("status") == KEEP
    why = (
        F.when(c("role") != "candidate", "role")
        .when(~c("status").isin(WINNER, KEEP), "decision")
        .when(F.coalesce(F.trim("expression"), F.lit("")) == "", "expression")
        .when(keep & (missing_core() > 0), "incomplete")
        .when(keep & _true(c("mean_turnover") > 0.25), "turnover")
        .when(keep & ~quality, "quality")
        .when(_true(c("corr_to_nearest_target") >= limit), "correlation")
        .when(_true(F.round("family_corr", 9) >= limit), "family_correlation")
    )
    z = lambda m: F.coalesce(m, F.lit(0.0))
    priority = [F.desc(F.round(z("winner_score"), 9)), F.desc(z("net_excess_ann_return")), F.desc(F.round(z("net_ann_return") + 0.25 * z("net_sharpe"), 9)), F.asc(z("mean_turnover")), F.asc("candidate_id")]
    d = d.withColumn("why", why)
    d = d.withColumn("_turn", F.row_number().over(Window.partitionBy("family", "status", c("why").isNull()).orderBy(*priority)))
    d = d.withColumn("why", F.when(c("why").isNull() & keep & (c("_turn") > most), "enough").otherwise(c("why")))
    return d.select("candidate_id", "family", c("why").isNull().alias("promoted"), F.coalesce("why", F.lit("passed")).alias("why"))


def quality_score() -> Column:
    bonus = F.when(c("status").isin(WINNER, "winner"), 0.05).when(c("status").isin(KEEP, "keep"), 0.02).when(c("status") == EXPLORATORY, 0.01).otherwise(0.0)
    return (
        0.34 * _tanh("quick_rank_icir", 0.35) + 0.26 * _tanh("net_sharpe", 3.0) + 0.18 * _tanh("net_excess_ann_return", 0.35) + 0.12 * _tanh("net_ann_return", 3.0)
        + 0.06 * _up("neutral_quick_rank_icir", 0.2) + 0.06 * _up("neutral_net_sharpe", 1.8) - 0.08 * _up("mean_turnover", 0.25) + bonus
    )


def reranked(df: DataFrame) -> DataFrame:
    """candidate_id, quality, adjustment, score: the quality score and the decorrelation's adjustment."""
    d = assessed(with_parent(df)).withColumn("quality", quality_score())
    return d.select("candidate_id", "quality", "adjustment", (c("quality") + c("adjustment")).alias("score"))


#: Guards that a record may name as having blocked it; the last one counts only where no other does.
GUARDS = ("true_parent_corr_guard_blocked", "stronger_candidate_corr_guard_blocked", "heuristic_parent_guard_blocked")


def flag(df: DataFrame, name: str, default: bool = False) -> Column:
    """A flag of a record (a number or boolean; missing, or without the column: the default)."""
    return F.coalesce(c(name).cast("double"), F.lit(float(default))) > 0.5 if name in df.columns else F.lit(default)


def select_anchor(df: DataFrame, min_icir: float = 0.20, min_sharpe: float = 1.0, max_turnover: float = 0.40, min_completeness: float = 0.75) -> DataFrame:
    """candidate_id, family, reasons (against it, joined by a bar), quality, anchor: the family's best candidate without a reason.

    Beside metrics and status, a record's flags count where df has them: eligible_for_best_node (true by default, and
    for winners), the three GUARDS, and corr_guard_blocked.
    """
    d = scored(df)
    promotable = c("status").isin(*KEPT, "winner", "keep")
    blocked = [flag(d, g) for g in GUARDS]
    reasons = F.concat_ws(
        "|",
        F.when(~promotable, F.lit("status_not_promotable")),
        F.when(~(_true(c("status").contains("winner")) | flag(d, "eligible_for_best_node", True)), F.lit("not_eligible_for_best_node")),
        F.when(1 - missing_core() / len(CORE) < min_completeness, F.lit("metrics_incomplete")),
        F.when(~_true(c("quick_rank_icir") >= min_icir), F.lit("icir_below_threshold")),
        F.when(~_true(c("net_sharpe") >= min_sharpe), F.lit("sharpe_below_threshold")),
        F.when(~_true(c("mean_turnover") <= max_turnover), F.lit("turnover_above_threshold")),
        *[F.when(on, F.lit(g)) for g, on in zip(GUARDS, blocked, strict=True)],
        F.when(flag(d, "corr_guard_blocked") & ~(blocked[0] | blocked[1] | blocked[2]), F.lit("corr_guard_blocked")),
    )
    q = (
        0.32 * _tanh("net_excess_ann_return", 0.35) + 0.24 * _tanh("quick_rank_icir", 0.35) + 0.18 * _tanh("net_sharpe", 3.0) + 0.10 * _tanh("quick_rank_ic_mean", 0.08)
        + 0.08 * _tanh("winner_score", 0.5) - 0.08 * _up("mean_turnover", 0.25) + F.when(c("status").contains("winner"), 0.08).otherwise(0.0)
    )
    d = d.withColumn("reasons", reasons).withColumn("quality", q)
    order = [F.desc(F.round("quality", 9)), *[F.desc_nulls_last(m) for m in ("net_excess_ann_return", "quick_rank_icir", "net_sharpe")], F.asc("candidate_id")]
    rank = F.row_number().over(Window.partitionBy("family", c("reasons") == "").orderBy(*order))
    return d.withColumn("_r", rank).select("candidate_id", "family", "reasons", "quality", ((c("reasons") == "") & (c("_r") == 1)).alias("anchor"))


# --- search scores -------------------------------------------------------------------------------------------


def metric_percentiles(df: DataFrame, values: dict[str, tuple[Column, Column]], least: int = 40) -> DataFrame:
    """df with each name: the share of the family's samples that are at most the value, for (sample, value) columns.

    A family of fewer than `least` samples gets the lowest of all samples added, up to `least`; if that many aren't
    to be had, the result is null.
    """
    steps = [F.struct(F.lit(n).alias("name"), x.cast("double").alias("at"), F.lit(k).alias("asks")) for n, pair in values.items() for k, x in enumerate(pair)]
    long = df.select("candidate_id", "family", F.explode(F.array(*steps)).alias("x")).select("candidate_id", "family", "x.*").where("at IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("name").orderBy("at"))
    lowest = long.where("asks = 0").withColumn("_r", first).where(c("_r") <= least).groupBy("name").agg(F.sort_array(F.collect_list("at")).alias("low"))
    family = Window.partitionBy("family", "name")
    sample = F.when(c("asks") == 0, 1).otherwise(0)
    # samples and values in one order: a sample stands before a value that equals it
    counted = long.withColumn("n", F.sum(sample).over(family)).withColumn("le", F.sum(sample).over(family.orderBy("at", "asks"))).where("asks = 1").join(lowest, "name", "left")
    low = F.coalesce("low", F.array().cast("array<double>"))
    extra = F.greatest(F.lit(0), F.least(least - c("n"), F.size(low)))
    below = F.least(extra, F.size(F.filter(low, lambda x: x <= c("at"))))
    share = F.when(c("n") + extra >= least, (c("le") + below) / (c("n") + extra))
    wide = counted.withColumn("share", share).groupBy(c("candidate_id").alias("_id")).agg(*[F.max(F.when(c("name") == n, c("share"))).alias(n) for n in values])
    return df.join(wide, c("candidate_id") == c("_id"), "left").drop("_id")


def based(df: DataFrame, least: int = 40) -> DataFrame:
    """df with base_score: weighted percentiles of the metrics (twice the share less 1; tanh where samples are too few), less penalties for turnover, depth and complexity, plus the status' bonus."""
    e = c("expression")
    # stored: samples, values and the result read the rows, and metrics and texts of candidates are costly
    d = Tables().stored(df.withColumn("_deep", depth(e).cast("double")).withColumn("_complex", complexity(e).cast("double")), "based")
    zero = F.lit(0.0)
    signed = {"quick_rank_ic_mean": (1.8, 0.08), "quick_rank_icir": (0.6, 0.6), "net_ann_return": (0.7, 1.8), "net_excess_ann_return": (0.6, 1.2), "net_sharpe": (0.8, 2.0)}
    values = {f"q_{m}": (c(m), F.coalesce(m, zero)) for m in signed}
    values |= {"q_turnover": (c("mean_turnover"), F.greatest(F.coalesce("mean_turnover", zero), zero)), "q_complex": (c("_complex"), c("_complex")), "q_deep": (c("_deep"), F.greatest(c("_deep") - 1, zero))}
    d = metric_percentiles(d, values, least)
    score = zero
    for m, (weight, scale) in signed.items():
        score = score + weight * F.coalesce(2 * c(f"q_{m}") - 1, _tanh(m, scale))
    penalty = 0.35 * F.coalesce("q_turnover", _up("mean_turnover", 0.45)) + 0.05 * F.coalesce("q_deep", _up(c("_deep") - 1, 3.0)) + 0.025 * F.coalesce("q_complex", _up("_complex", 8.0))
    bonus = F.when(c("status").contains("winner"), 0.05).when(c("status").contains("keep"), 0.02).otherwise(0.0)
    return d.withColumn("base_score", score + bonus - penalty).drop("_deep", "_complex", *values)


def base_score(df: DataFrame) -> DataFrame:
    return based(df).select("candidate_id", c("base_score").alias("score"))


def corr_risk() -> Column:
    """The correlation that a status or reason names, 0.5 if it names none but speaks of redundancy, else 0."""
    text = F.lower(F.concat_ws(" ", "status", "reason"))
    value = F.regexp_extract(text, r"corr[^=]*=\s*([0-9.]+)", 1)
    return F.when(~(text.contains("redundant") | text.contains("corr")), 0.0).when(value != "", _clamp(F.coalesce(value.try_cast("double"), F.lit(0.5)))).otherwise(0.5)


def profile_stats(df: DataFrame) -> DataFrame:
    """family, profile_key, n, corr_risk (mean of the risks above 0; null without any) of profiled candidates."""
    risk = corr_risk()
    return df.groupBy("family", "profile_key").agg(F.count("*").alias("n"), F.avg(F.when(risk > 0, risk)).alias("corr_risk"))


def target_scores(df: DataFrame, weight: float = 0.24, constraint_weight: float = 0.25, portfolio_weight: float = 0.85) -> DataFrame:
    """candidate_id, constraint, most_alike, mean_alike, portfolio, target of the search for complements.

    constraint: turnover, complexity, reliability and how seldom the profile is. portfolio: unlikeness to the
    references, the eight newest kept candidates of the family's other runs.
    """
    # stored: profiles are counted, and candidates meet their references
    d = Tables().stored(profiled(df), "profiled")
    j = d.join(profile_stats(d), ["family", "profile_key"])
    risk = F.coalesce("corr_risk", F.lit(0.0))
    seldom = 1 - F.greatest(_clamp((c("n") - 1) / 5), _clamp(risk))
    reliable = _clamp(0.75 * (1 - missing_core() / len(CORE)) + 0.25)
    constraint = _clamp(0.30 * (1 - _up("mean_turnover", 0.45)) + 0.20 * (1 - _up(complexity(c("expression")), 8.0)) + 0.30 * reliable + 0.20 * seldom - 0.10 * _clamp(missing_core() / 4))
    novel = 1 - _clamp(c("n") / 6)
    own = F.struct("profile_key", "operator_skeleton", "motif", "mutation", "economic_tags", "expression")
    j = j.withColumns({"_risk": _clamp(risk), "_novel": novel, "_constraint": constraint, "_own": own, "_many": F.greatest(c("n") - 1, F.lit(0)) / 6})
    refs = reference_candidates(d).select("run_id", c("candidate_id").alias("_ref"), "rank").join(d.select(c("candidate_id").alias("_ref"), own.alias("_other")), "_ref")
    x, y = c("_own"), c("_other")
    same = lambda f: F.when(x[f] == y[f], 1.0).otherwise(0.0)
    tags = jaccard(x["economic_tags"], y["economic_tags"])
    alike = _clamp(0.25 * same("profile_key") + 0.20 * same("operator_skeleton") + 0.15 * same("motif") + 0.10 * same("mutation") + 0.15 * tags + 0.15 * jaccard(keywords(x["expression"]), keywords(y["expression"])))
    unlike = _clamp(0.35 * (1 - same("operator_skeleton")) + 0.20 * (1 - same("motif")) + 0.20 * (1 - same("mutation")) + 0.25 * (1 - tags))
    # eight references a run at most: they go to the candidates' tasks
    met = j.select("candidate_id", "run_id", "_own").join(F.broadcast(refs), "run_id").where("candidate_id <> _ref")
    met = met.select("candidate_id", "rank", F.round(alike, 9).alias("alike"), unlike.alias("unlike"))
    best = met.groupBy("candidate_id").agg(F.max("alike").alias("most_alike"), F.avg("alike").alias("mean_alike"), F.max_by("unlike", F.struct("alike", (-c("rank")).alias("r"))).alias("_unlike"))
    j = j.join(best, "candidate_id", "left")
    most, mean = c("most_alike"), c("mean_alike")
    with_refs = 0.50 * (1 - most) + 0.15 * (1 - mean) + 0.25 * c("_unlike") + 0.10 * c("_novel") - 0.20 * _clamp((most - 0.35) / 0.45) - 0.10 * _clamp(0.60 * c("_risk") + 0.40 * c("_many"))
    portfolio = F.when(most.isNull(), _clamp(0.70 + 0.30 * c("_novel") - 0.10 * c("_risk"))).otherwise(_clamp(with_refs))
    j = j.withColumn("portfolio", portfolio)
    return j.select("candidate_id", c("_constraint").alias("constraint"), "most_alike", "mean_alike", "portfolio", (weight * (constraint_weight * c("_constraint") + portfolio_weight * c("portfolio"))).alias("target"))


def gained() -> Column:
    """Gain of a child on its parent, missing metrics as 0, within -1 and 1."""
    z = lambda m: F.coalesce(m, F.lit(0.0)) - F.coalesce(f"p_{m}", F.lit(0.0))
    g = (
        0.35 * _tanh(z("net_sharpe"), 1.5) + 0.25 * _tanh(z("net_excess_ann_return"), 0.5) + 0.20 * _tanh(z("net_ann_return"), 1.0)
        + 0.10 * _tanh(z("quick_rank_icir"), 0.3) + 0.10 * _tanh(z("quick_rank_ic_mean"), 0.05) - 0.15 * _up(z("mean_turnover"), 0.15)
    )
    return F.greatest(F.least(g, F.lit(1.0)), F.lit(-1.0))


def parent_child_gain(df: DataFrame) -> DataFrame:
    return with_parent(df, METRICS).where("p_id IS NOT NULL").select("candidate_id", "parent_candidate_id", gained().alias("gain"))


def child_statistics(df: DataFrame) -> DataFrame:
    """One row a parent: what its children are like. df: candidates with metrics."""
    d = profiled(df).withColumn("branch", F.coalesce("parent_candidate_id", "candidate_id").cast("string"))
    d = d.withColumn("_x", compared())
    j = with_parent(d, (*METRICS, "motif", "round_id", "_x")).where("p_id IS NOT NULL").withColumn("gain", F.round(gained(), 12))
    kept, won = c("status").isin(*KEPT, "winner", "keep"), c("status").isin(WINNER, "winner")
    low = F.coalesce(F.least(F.greatest(c("p_mean_turnover") * 1.10, F.lit(0.12)), F.lit(0.30)), F.lit(0.20))
    excess, cheap, full = _true(c("net_excess_ann_return") > 0), _true(c("mean_turnover") <= low), missing_core() == 0
    other = c("motif") != c("p_motif")
    rank = F.row_number().over(Window.partitionBy("parent_candidate_id").orderBy(F.desc("gain"), "candidate_id"))
    j = j.withColumn("_rank", rank).withColumn("_alike", likeness(c("_x"), c("p__x")))
    g = j.groupBy("parent_candidate_id").agg(
        F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(won).alias("won"),
        F.greatest(F.max("gain"), F.lit(0.0)).alias("best"), F.avg(F.when(c("_rank") <= 3, c("gain"))).alias("top3"), F.percentile("gain", 0.5).alias("median"),
        F.avg(F.when(c("gain") > 0, 1.0).otherwise(0.0)).alias("positive"), F.when(F.count("*") > 1, F.stddev_pop("gain")).otherwise(0.0).alias("spread"),
        F.count_distinct("source_model").alias("models"), F.count_distinct("mutation").alias("mutations"),
        F.avg(excess.cast("double")).alias("excess_rate"), F.avg(cheap.cast("double")).alias("cheap_rate"), F.avg(full.cast("double")).alias("full_rate"), F.avg((excess & cheap & full).cast("double")).alias("friendly_rate"),
        F.count_if((c("gain") > 0.15) & (F.round("_alike", 9) < 0.65) & kept).alias("novel"), F.count_if(other).alias("other_motifs"), F.count_if(other & kept).alias("other_kept"),
        F.greatest(F.max("p_round_id"), F.max("round_id")).alias("now"), F.max(F.when(kept | (c("gain") > 0), c("round_id"))).alias("success"),
    )
    support = j.groupBy("parent_candidate_id", "motif").agg(F.count_distinct("source_model").alias("m")).groupBy("parent_candidate_id").agg(F.max("m").alias("support"))
    return g.join(support, "parent_candidate_id")


def expandability(df: DataFrame) -> DataFrame:
    """parent_candidate_id, total, expandability: how far a parent's children speak for expanding it again."""
    t = c("total").cast("double")
    e = 0.35 * (c("kept") + 1) / (t + 3) + 0.25 * (c("won") + 1) / (t + 4) + 0.20 * _clamp((c("best") + 1) / 2) + 0.10 * F.least(c("models") / 3, F.lit(1.0)) + 0.10 * F.least(c("mutations") / 4, F.lit(1.0))
    return child_statistics(df).select("parent_candidate_id", "total", (e * F.least(t / 8, F.lit(1.0))).alias("expandability"))


def branch_value(df: DataFrame) -> DataFrame:
    """parent_candidate_id and the four parts and the value of its branch."""
    unit = lambda x: _clamp((c(x) + 1) / 2)
    gain = 0.35 * unit("best") + 0.30 * unit("top3") + 0.20 * unit("median") + 0.15 * c("positive")
    converges = F.when(c("models") > 1, _clamp((c("support") - 1) / (c("models") - 1))).otherwise(0.0)
    stable = 0.35 * F.least(c("models") / 3, F.lit(1.0)) + 0.35 * converges + 0.30 * (1 - F.least(c("spread") / 0.6, F.lit(1.0)))
    admission = 0.30 * c("excess_rate") + 0.20 * c("cheap_rate") + 0.20 * c("full_rate") + 0.30 * c("friendly_rate")
    novelty = 0.35 * F.least(c("novel") / 3, F.lit(1.0)) + 0.35 * F.when(c("other_motifs") > 0, c("other_kept") / c("other_motifs")).otherwise(0.0) + 0.30 * F.least(c("mutations") / 4, F.lit(1.0))
    since = F.when(c("success") > 0, F.greatest(c("now") - c("success"), F.lit(0))).otherwise(0)
    d = child_statistics(df).select("parent_candidate_id", "total", gain.alias("gain"), stable.alias("stability"), admission.alias("admission"), novelty.alias("novelty"), F.greatest(F.lit(0.4), 1 - 0.12 * since).alias("recency"))
    value = F.least(c("total") / 10, F.lit(1.0)) * c("recency") * (0.35 * c("gain") + 0.25 * c("stability") + 0.25 * c("admission") + 0.15 * c("novelty"))
    return d.select("parent_candidate_id", "gain", "stability", "admission", "novelty", value.alias("branch"))


def frontier(df: DataFrame) -> DataFrame:
    """Profiled candidates with branch (the parent, else the candidate itself) and base_score."""
    return based(profiled(df)).withColumn("branch", F.coalesce("parent_candidate_id", "candidate_id").cast("string"))


def capped_top_k(df: DataFrame, k_branch: int = 2, k_motif: int = 3, n: int = 6) -> DataFrame:
    """Each family's n best by base score, of those within the first k_branch of their branch and the first k_motif of their motif."""
    order = [F.desc(F.round("base_score", 9)), F.asc("candidate_id")]
    d = frontier(df)
    d = d.withColumn("_b", F.row_number().over(Window.partitionBy("family", "branch").orderBy(*order))).withColumn("_m", F.row_number().over(Window.partitionBy("family", "motif").orderBy(*order)))
    return top_n(d.where((c("_b") <= k_branch) & (c("_m") <= k_motif)), ["family"], n, *order).select("family", "rank", "candidate_id", c("base_score").alias("score"))


def pool_pairs(df: DataFrame, pool: int = 8) -> DataFrame:
    """a, b: pairs of each family's `pool` best candidates by base score, and children with their parents. df: frontier()."""
    best = top_n(df, ["family"], pool, F.desc(F.round("base_score", 9)), F.asc("candidate_id")).select("family", "candidate_id")
    lists = best.groupBy("family").agg(F.sort_array(F.collect_list("candidate_id")).alias("ids")).select(F.explode("ids").alias("a"), "ids")
    inside = lists.select("a", F.explode("ids").alias("b")).where("a < b")
    return inside.unionByName(df.where("parent_candidate_id IS NOT NULL").select(c("parent_candidate_id").alias("a"), c("candidate_id").alias("b"))).distinct()


def mmr_select(df: DataFrame, n: int = 5, weight: float = 0.72, tables: Tables | None = None) -> DataFrame:
    """family, position, candidate_id: n diverse candidates a family, of all it has. df: frontier().

    Each next maximises weight * score (between 0 and 1 within the family) - (1 - weight) * greatest likeness to those
    chosen; the better score, then the smaller id, on ties. A round is one aggregate and one join with the family's last
    choice. Likeness lies between 0 and 1, so n candidates are worth at least weight * (the n-th score) - (1 - weight)
    each: who cannot reach that even unlike all others is never looked at.
    """
    tables = tables or Tables()
    scores = tables.stored(df.select("family", "candidate_id", c("base_score").alias("score"), compared().alias("x")), "scores")
    spans = scores.groupBy(c("family").alias("_f")).agg(F.min("score").alias("_low"), F.greatest(F.max("score") - F.min("score"), F.lit(1e-12)).alias("_span"))
    named = scores.join(spans, c("family").eqNullSafe(c("_f"))).select("family", "candidate_id", F.round("score", 9).alias("score"), "x", ((c("score") - c("_low")) / c("_span")).alias("unit"))
    best = top_n(named, ["family"], n, F.desc("unit")).groupBy(c("family").alias("_f")).agg(F.min("unit").alias("_least"))
    left = named.join(best, c("family").eqNullSafe(c("_f"))).where(c("unit") * weight >= c("_least") * weight - (1 - weight) - 1e-9).drop("_f", "_least")
    left = tables.stored(left.withColumn("near", F.lit(0.0)), "left")
    chosen = None
    for k in range(n):
        value = F.struct(F.round(weight * c("unit") - (1 - weight) * c("near"), 9).alias("v"), "score", (-c("candidate_id")).alias("i"))
        took = left.groupBy(c("family").alias("_f")).agg(F.max_by(F.struct("candidate_id", "x"), value).alias("took")).select("_f", c("took.candidate_id").alias("_id"), c("took.x").alias("_x"))
        took = tables.stored(took.withColumn("position", F.lit(k)), "took")
        chosen = took if chosen is None else chosen.unionByName(took)
        if k < n - 1:
            rest = left.join(took, c("family").eqNullSafe(c("_f"))).where(c("candidate_id") != c("_id"))
            left = tables.stored(rest.withColumn("near", F.greatest("near", likeness(c("x"), c("_x")))).select("family", "candidate_id", "score", "x", "unit", "near"), "left")
    return chosen.select(c("_f").alias("family"), "position", c("_id").alias("candidate_id"))
