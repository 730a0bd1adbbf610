"""Archive analytics and the research funnel over candidates and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators.candidates import bare, expression_tags, keywords

WINNER, KEEP = "research_winner", "research_keep"
WINNERS, KEEPS = (WINNER, "winner"), (KEEP, "keep")
#: Order of states, best first (fixed values).
PRIORITY = {"research_winner": 4, "winner": 3, "research_keep": 2, "keep": 1}
METRICS = ("quick_rank_ic_mean", "quick_rank_icir", "net_ann_return", "net_excess_ann_return", "net_sharpe", "mean_turnover")
#: How much a theme of one family suits a theme of another (fixed values).
THEMES = {
    "pressure_distribution": {"pressure_distribution": 1.0, "volume_liquidity": 0.8, "anchor_centroid": 0.5, "downside_position": 0.35},
    "volume_liquidity": {"volume_liquidity": 1.0, "pressure_distribution": 0.8, "open_marketfit": 0.45, "neutralization": 0.35},
    "amplitude_volatility": {"amplitude_volatility": 1.0, "downside_position": 0.55, "quality_momentum": 0.45, "volume_liquidity": 0.35},
    "downside_position": {"downside_position": 1.0, "anchor_centroid": 0.7, "amplitude_volatility": 0.55, "pressure_distribution": 0.35},
    "anchor_centroid": {"anchor_centroid": 1.0, "downside_position": 0.7, "pressure_distribution": 0.5, "volume_liquidity": 0.35},
    "open_marketfit": {"open_marketfit": 1.0, "volume_liquidity": 0.45, "neutralization": 0.45, "quality_momentum": 0.25},
    "quality_momentum": {"quality_momentum": 1.0, "amplitude_volatility": 0.45, "pressure_distribution": 0.25, "volume_liquidity": 0.2},
    "neutralization": {"neutralization": 1.0, "open_marketfit": 0.45, "volume_liquidity": 0.35, "pressure_distribution": 0.2},
}

c = F.col


def top_n(df: DataFrame, by: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)


def fetch_candidates(df: DataFrame, statuses: Sequence[str] = (), n: int = 3, exclude: Sequence[str] = (), run_id: str = "", exclude_run_id: str = "", dedup: bool = True) -> DataFrame:
    """The newest n candidates of each family (or of one run) in, or not in, given states, one of each expression, with the parent's name."""
    some = df
    if run_id:
        some = some.where(c("run_id") == run_id)
    if exclude_run_id:
        some = some.where(c("run_id") != exclude_run_id)
    if statuses:
        some = some.where(c("status").isin(list(statuses)))
    if exclude:
        some = some.where(~c("status").isin(list(exclude)))
    if dedup:
        some = top_n(some, ["family", "expression"], 1, F.desc("candidate_id")).drop("rank")
    parents = df.select(c("candidate_id").alias("parent_candidate_id"), c("factor_name").alias("parent_name"))
    best = top_n(some, ["family"], n, F.desc("candidate_id"))
    return best.join(parents, "parent_candidate_id", "left").select("family", "rank", "candidate_id", "factor_name", "parent_name", "status", "net_sharpe")


def recent_winners(df: DataFrame, n: int = 3) -> DataFrame:
    return fetch_candidates(df, WINNERS, n)


def recent_keeps(df: DataFrame, n: int = 3) -> DataFrame:
    return fetch_candidates(df, KEEPS, n)


def failures(df: DataFrame, n: int = 3) -> DataFrame:
    """As recent_winners(), of those that neither won nor were kept nor are only proposed."""
    return fetch_candidates(df, n=n, exclude=(*WINNERS, *KEEPS, "proposed"))


def lineage(df: DataFrame, hops: int = 3) -> DataFrame:
    """candidate_id, ancestors: up to `hops` parents, nearest first; a loop ends the walk."""
    edges = df.select(c("candidate_id").alias("_c"), c("parent_candidate_id").alias("_p")).where("_p is not null")
    at = df.select("candidate_id", F.array("candidate_id").alias("seen"), c("candidate_id").alias("now"))
    for _ in range(hops):
        at = at.join(edges, c("now") == c("_c"), "left")
        new = c("_p").isNotNull() & ~F.array_contains("seen", c("_p"))
        at = at.select("candidate_id", F.when(new, F.array_append("seen", c("_p"))).otherwise(c("seen")).alias("seen"), F.when(new, c("_p")).alias("now"))
    return at.select("candidate_id", F.array_join(F.slice("seen", 2, hops), ">").alias("ancestors"))


def best_winner(df: DataFrame) -> DataFrame:
    """Each family's winner by mean coefficient, icir, excess, sharpe, annual return, low turnover, newest."""
    order = [F.desc_nulls_last(m) for m in ("quick_rank_ic_mean", "quick_rank_icir", "net_excess_ann_return", "net_sharpe", "net_ann_return")]
    best = top_n(df.where(c("status").isin(*WINNERS)), ["family"], 1, *order, F.asc_nulls_last("mean_turnover"), F.desc("candidate_id"))
    return best.select("family", "candidate_id", "quick_rank_ic_mean", "net_sharpe")


def latest_winner(df: DataFrame) -> DataFrame:
    """Each family's winner of the latest round, the newest of it."""
    return top_n(df.where(c("status").isin(*WINNERS)), ["family"], 1, F.desc("round_id"), F.desc("candidate_id")).select("family", "round_id", "candidate_id", "factor_name")


def runs(df: DataFrame) -> DataFrame:
    """A row a run: family, run_id, round_id, started (its first candidate), n_candidates."""
    return df.groupBy("family", "run_id", "round_id").agg(F.min("candidate_id").alias("started"), F.count("*").alias("n_candidates"))


def latest_round(df: DataFrame) -> DataFrame:
    return df.groupBy("family").agg(F.max("round_id").alias("latest_round"), F.max_by("candidate_id", F.struct("round_id", "candidate_id")).alias("latest_candidate"), F.count("*").alias("n_candidates"))


def latest_run(df: DataFrame) -> DataFrame:
    """Each family's run that was started last."""
    return top_n(runs(df), ["family"], 1, F.desc("started"), F.desc("run_id")).select("family", "run_id", "round_id", "n_candidates")


def run_counts(df: DataFrame) -> DataFrame:
    return runs(df).groupBy("family").agg(F.count("*").alias("n_runs"))


def status_counts(df: DataFrame) -> DataFrame:
    """Counts by family, by status, and of both, in one pass of grouping sets."""
    return df.cube("family", "status").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def _top_labels(rows: DataFrame, by: Sequence[str], label: str, name: str, k: int = 3) -> DataFrame:
    """by, name: the k most frequent labels of each group joined by a bar, ties by label."""
    counted = rows.where(c(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    best = top_n(counted, by, k, F.desc("n"), F.asc(label))
    return best.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", c(label).alias("label")))), lambda x: x.label), "|").alias(name))


def model_summary(df: DataFrame, newest: int = 500) -> DataFrame:
    """Totals of each model in a family's newest candidates: winners, keeps, failures, mean metrics of its winners, commonest tags and reasons."""
    d = top_n(df.where("source_model <> ''"), ["family"], newest, F.desc("candidate_id"))
    won, kept, failed = c("status").isin(*WINNERS), c("status").isin(*KEEPS), ~c("status").isin(*WINNERS, *KEEPS, "proposed")
    by = ["family", "source_model"]
    totals = d.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(won).alias("winners"), F.count_if(kept).alias("keeps"), F.count_if(failed).alias("failures"),
        F.avg(F.when(won, c("net_sharpe"))).alias("winner_sharpe"), F.avg(F.when(won, c("net_excess_ann_return"))).alias("winner_excess"),
    )
    tags = _top_labels(d.where(won | kept).select(*by, F.explode(expression_tags(c("expression"))).alias("tag")), by, "tag", "success_tags")
    reasons = _top_labels(d.where(failed), by, "reason", "failure_reasons")
    return totals.join(tags, by, "left").join(reasons, by, "left")


def reason_counts(df: DataFrame, k: int = 3) -> DataFrame:
    """The k most common states of failures for each model."""
    n = df.where(~c("status").isin(WINNER, KEEP, "proposed")).groupBy("source_model", "status").agg(F.count("*").alias("n"))
    return top_n(n, ["source_model"], k, F.desc("n"), F.asc("status"))


def reference_candidates(df: DataFrame, n: int = 8) -> DataFrame:
    """family, run_id, rank, candidate_id: for every run, the n newest kept candidates of the family's other runs.

    Only the n newest of a run can count for another, so few rows of each run meet the family's runs.
    """
    kept = top_n(df.where(c("status").isin(*WINNERS, *KEEPS)), ["family", "run_id"], n, F.desc("candidate_id")).select("family", c("run_id").alias("_run"), "candidate_id")
    met = df.select("family", "run_id").distinct().join(kept, "family").where("run_id <> _run")
    return top_n(met, ["family", "run_id"], n, F.desc("candidate_id")).select("family", "run_id", "rank", "candidate_id")


def reflection_card(df: DataFrame, recent: int = 3) -> DataFrame:
    """One row a run: its best winner and metrics, keeps and failures, commonest tags of the newest successes and reasons of the newest failures, models' shares.

    Successes: the best winner and the run's `recent` newest keeps; failures: its `recent` newest ones.
    """
    won, kept = c("status").isin(*WINNERS), c("status").isin(*KEEPS, "research_keep_exploratory")
    failed = ~won & ~kept & (c("status") != "proposed")
    card = df.groupBy("family", "run_id").agg(F.count_if(kept).alias("keeps"), F.count_if(failed).alias("failures"))
    order = [F.desc_nulls_last(m) for m in ("net_sharpe", "net_excess_ann_return", "net_ann_return", "quick_rank_icir")]
    best = top_n(df.where(won), ["run_id"], 1, *order, F.asc("candidate_id"))
    successes = best.unionByName(top_n(df.where(kept), ["run_id"], recent, F.desc("candidate_id")))
    tags = _top_labels(successes.select("run_id", F.explode(expression_tags(c("expression"))).alias("tag")), ["run_id"], "tag", "success_tags")
    reasons = _top_labels(top_n(df.where(failed), ["run_id"], recent, F.desc("candidate_id")), ["run_id"], "reason", "failure_reasons")
    models = df.where(won | kept).groupBy("run_id", "source_model").agg(F.count("*").alias("n")).groupBy("run_id")
    shares = models.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-c("n")).alias("m"), "source_model", "n"))), lambda x: F.concat_ws("=", x.source_model, x.n.cast("string"))), "|").alias("models"))
    one = best.select("run_id", c("candidate_id").alias("best"), c("net_sharpe").alias("best_sharpe"), c("quick_rank_icir").alias("best_icir"))
    return card.join(one, "run_id", "left").join(tags, "run_id", "left").join(reasons, "run_id", "left").join(shares, "run_id", "left")


def family_inventory(families: DataFrame, df: DataFrame) -> DataFrame:
    """All families (family, priority) with their number of runs (0 if none), a status by it, and their place in the order of status, priority and name."""
    counts = families.join(run_counts(df), "family", "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)).cast("long"))
    done = F.when(c("n_runs") >= 3, "new_framework_done").when(c("n_runs") > 0, "new_framework_started").otherwise("seed_only")
    place = F.when(c("status") == "seed_only", 0).when(c("status") == "new_framework_started", 2).otherwise(3)
    rank = F.when(c("priority") == "high", 0).when(c("priority") == "medium", 1).when(c("priority") == "low", 2).otherwise(9)
    # a row a family: one small partition
    d = counts.withColumn("status", done)
    return d.withColumn("position", F.row_number().over(Window.orderBy(place, rank, "family"))).select("family", "priority", "n_runs", "status", "position")


def donor_match(targets: DataFrame, df: DataFrame, k: int = 2, records: int = 5) -> DataFrame:
    """family, rank, donor, candidate_id, score: for each family the best k records of other families.

    targets: family, themes, keywords of all families. Records: each family's newest winners, then keeps, one of
    each expression, with their tags' themes. A record scores 10 a theme in common, 6 times how the themes suit each
    other (none: no match), 1.5 a keyword in common (8 at most), and its quality; themes meet through the table of
    what suits what.
    """
    fits = [F.struct(F.lit(a).alias("theme"), F.lit(b).alias("source"), F.lit(w).alias("fit")) for a, row in THEMES.items() for b, w in row.items()]
    one = top_n(df.where(c("status").isin(*WINNERS, *KEEPS)), ["family", "status", "expression"], 1, F.desc("candidate_id")).drop("rank")
    newest = top_n(one, ["family"], records, F.when(c("status").isin(*WINNERS), 0).otherwise(1), F.desc("candidate_id")).drop("rank")
    t = expression_tags(c("expression"))
    any_ = lambda *names: F.arrays_overlap(t, F.array(*[F.lit(x) for x in names]))
    implied = F.array_compact(F.array(
        F.when(any_("amount", "volume", "turnover", "rel_amount", "rel_volume"), F.lit("volume_liquidity")), F.when(any_("ema", "decay_linear", "ts_rank", "cs_rank"), F.lit("quality_momentum")),
        F.when(any_("where", "bucket_sum"), F.lit("pressure_distribution")), F.when(any_("corr", "ts_corr", "cov", "ts_cov"), F.lit("open_marketfit")),
    ))
    own = newest.join(targets.select("family", c("themes").alias("_themes"), c("keywords").alias("_words")), "family")
    source = own.select(c("family").alias("donor"), "candidate_id", "status", "net_sharpe", "net_excess_ann_return", F.array_union("_themes", implied).alias("sources"), F.array_union(F.array_union("_words", keywords(c("expression"))), t).alias("words"))
    met = targets.select("family", "themes", "keywords", F.explode("themes").alias("theme"), F.array(*fits).alias("fits"))
    met = met.select("family", "keywords", "theme", F.explode(F.filter("fits", lambda x: x.theme == c("theme"))).alias("x")).select("family", "keywords", "theme", c("x.source").alias("source"), c("x.fit").alias("fit"))
    pairs = met.join(source.withColumn("source", F.explode("sources")), "source").where("donor <> family")
    shared = F.size(F.array_intersect("keywords", "words"))
    by = ["family", "donor", "candidate_id"]
    scored = pairs.groupBy(*by).agg(F.sum(F.when(c("theme") == c("source"), 10.0).otherwise(0.0) + 6.0 * c("fit")).alias("theme"), F.max(shared).alias("shared"), F.first("status").alias("status"), F.first("net_sharpe").alias("sharpe"), F.first("net_excess_ann_return").alias("excess"))
    up = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    s = c("theme") + 1.5 * F.least("shared", F.lit(8)) + 0.18 * up("sharpe") + 0.25 * up("excess") + F.when(c("status").isin(*WINNERS), 1.2).otherwise(0.5)
    return top_n(scored.withColumn("score", s), ["family"], k, F.desc(F.round("score", 9)), F.asc("candidate_id")).select("family", "rank", "donor", "candidate_id", "score")


def parent_metric_source(df: DataFrame) -> DataFrame:
    """For each expression, the row whose metrics stand for it: candidates before parents, then by excess, icir, sharpe, mean coefficient, newest."""
    rows = df.where(F.coalesce(*METRICS).isNotNull()).withColumn("_key", bare(c("expression")))
    order = [F.desc(c("role") == "candidate"), *[F.desc_nulls_last(m) for m in ("net_excess_ann_return", "quick_rank_icir", "net_sharpe", "quick_rank_ic_mean")], F.desc("candidate_id")]
    return top_n(rows, ["_key"], 1, *order).select("expression", "candidate_id", "net_excess_ann_return")


# --- research funnel -----------------------------------------------------------------------------------------


def _best_first() -> list[Column]:
    rank = F.lit(0)
    for status, value in PRIORITY.items():
        rank = F.when(c("status") == status, value).otherwise(rank)
    return [F.desc(rank), F.desc_nulls_last(F.round("winner_score", 9)), *[F.desc_nulls_last(m) for m in ("quick_rank_icir", "net_excess_ann_return", "net_sharpe")], F.asc_nulls_last("mean_turnover"), F.asc("candidate_id")]


def top_k_candidates(df: DataFrame, k: int = 3) -> DataFrame:
    """Each run's k best candidates by state, winner score, icir, excess, sharpe and low turnover. df has winner_score."""
    return top_n(df.where("role = 'candidate'"), ["family", "run_id"], k, *_best_first())


def top3_stats(df: DataFrame) -> DataFrame:
    """Of each run's three best: mean of the metrics, share positive and population deviation of the main ones."""
    out = [F.avg(m).alias(f"{m}_mean") for m in METRICS]
    for m in ("quick_rank_ic_mean", "quick_rank_icir", "net_excess_ann_return", "net_sharpe"):
        out += [F.avg(F.when(c(m) > 0, 1.0).when(c(m).isNotNull(), 0.0)).alias(f"{m}_positive"), F.when(F.count(m) >= 2, F.stddev_pop(m)).alias(f"{m}_std")]
    zero = lambda m: F.avg(F.abs(F.coalesce(m, F.lit(0.0))))
    return top_k_candidates(df).groupBy("family", "run_id").agg(F.count("*").alias("n"), *out, zero("quick_rank_ic_mean").alias("mean_abs_ic"), zero("quick_rank_icir").alias("mean_abs_icir"))


def _uplift(d: dict[str, Column]) -> Column:
    """Weighted deltas of icir, excess, sharpe and annual return, less the rise of turnover; missing ones are left out."""
    score, seen = F.lit(0.0), F.lit(False)
    for weight, m in ((0.25, "quick_rank_icir"), (0.35, "net_excess_ann_return"), (0.20, "net_sharpe"), (0.20, "net_ann_return")):
        score, seen = score + weight * F.coalesce(d[m], F.lit(0.0)), seen | d[m].isNotNull()
    rise = F.greatest(F.coalesce(d["mean_turnover"], F.lit(0.0)), F.lit(0.0))
    return F.when(seen | (rise > 0), score - 0.15 * rise)


_SHOWN = ("quick_rank_icir", "net_excess_ann_return", "net_sharpe")


def run_records(df: DataFrame) -> DataFrame:
    """A row a run: counts, formalised factors, best winner, and deltas and uplift against the family's two seeds. df has winner_score.

    d_*, uplift: against the canonical seed, the family's first parent. a_*, sign_aware_uplift: against the preferred seed, a
    parent that df marks as preferred (the newest of them), else the canonical one. d3_*, a3_*: the mean of the three best
    candidates against either. formalised: the run's candidates that the newest admission of their expression inserted.
    """
    parents = df.where("role = 'parent'")
    preferred = F.coalesce(c("preferred"), F.lit(False)) if "preferred" in df.columns else F.lit(False)
    seed = top_n(parents, ["family"], 1, F.asc("candidate_id")).select("family", *[c(m).alias(f"s_{m}") for m in METRICS])
    other = top_n(parents.where(preferred), ["family"], 1, F.desc("candidate_id")).select("family", F.lit(True).alias("_own"), *[c(m).alias(f"p_{m}") for m in METRICS])
    rows = df.where("role = 'candidate'")
    counts = rows.groupBy("family", "run_id").agg(F.count("*").alias("evaluated"), F.count_if(c("status").isin(*KEEPS)).alias("keeps"), F.count_if(c("status").isin(*WINNERS)).alias("winners"), F.max("target_profile").alias("target_profile"))
    best = top_n(rows.where(c("status").isin(*WINNERS)), ["run_id"], 1, *_best_first()).select("run_id", "candidate_id", *[c(m).alias(f"w_{m}") for m in METRICS])
    three = top_k_candidates(df).groupBy("run_id").agg(*[F.avg(m).alias(f"t_{m}") for m in METRICS])
    made = admission_latest(df).where("inserted").select(c("candidate_id").alias("_id")).join(rows.select(c("candidate_id").alias("_cand"), "run_id"), c("_id") == c("_cand")).groupBy("run_id").agg(F.count("*").alias("formalised"))
    j = counts.join(seed, "family", "left").join(other, "family", "left").join(best, "run_id", "left").join(three, "run_id", "left").join(made, "run_id", "left")
    aware = {m: F.when(c("_own"), c(f"p_{m}")).otherwise(c(f"s_{m}")) for m in METRICS}
    d, a = {m: c(f"w_{m}") - c(f"s_{m}") for m in METRICS}, {m: c(f"w_{m}") - aware[m] for m in METRICS}
    d3, a3 = {m: c(f"t_{m}") - c(f"s_{m}") for m in METRICS}, {m: c(f"t_{m}") - aware[m] for m in METRICS}
    shown = [x[m].alias(f"{p}_{m}") for p, x in (("d", d), ("a", a), ("d3", d3), ("a3", a3)) for m in _SHOWN]
    return j.select("family", "run_id", "target_profile", "candidate_id", "evaluated", "keeps", "winners", F.coalesce("formalised", F.lit(0).cast("long")).alias("formalised"), *shown, _uplift(d).alias("uplift"), _uplift(a).alias("sign_aware_uplift"))


def uplift(df: DataFrame) -> DataFrame:
    return run_records(df).select("family", "run_id", "candidate_id", "uplift")


def family_funnel(df: DataFrame) -> DataFrame:
    """Totals, means and medians of the runs of each family, and of each (family, target profile) by grouping sets, with a recommended state.

    donor_mode: median rise of excess above the preferred seed of more than 0.5, and 3 formalised factors; keep_refining: median
    sign-aware uplift positive and a formalised factor; focused_refine_only: that rise positive; else pause.
    """
    r = run_records(df).withColumn("profile", F.coalesce("target_profile", F.lit("default")))
    median = lambda x: F.percentile(x, 0.5)
    names = {"excess": "net_excess_ann_return", "sharpe": "net_sharpe", "icir": "quick_rank_icir"}
    medians = [median(f"{p}_{m}").alias(f"{q}median_{n}") for p, q in (("d", ""), ("a", "sign_aware_")) for n, m in names.items()]
    threes = [F.avg(f"{p}3_{names[n]}").alias(f"{q}top3_{n}") for p, q in (("d", ""), ("a", "sign_aware_")) for n in ("excess", "sharpe")]
    g = r.groupingSets([["family"], ["family", "profile"]], "family", "profile").agg(
        F.count("*").alias("runs"), F.sum("evaluated").alias("evaluated"), F.sum("keeps").alias("keeps"), F.sum("winners").alias("winners"), F.sum("formalised").alias("formalised"), F.avg(c("keeps") / c("evaluated")).alias("keep_rate"),
        median("uplift").alias("median_uplift"), median("sign_aware_uplift").alias("sign_aware_median_uplift"), *medians, *threes,
    )
    rise, gain = F.round("sign_aware_median_excess", 9), F.round("sign_aware_median_uplift", 9)
    state = F.when((rise > 0.5) & (c("formalised") >= 3), "donor_mode").when((gain > 0) & (c("formalised") > 0), "keep_refining").when(rise > 0, "focused_refine_only").otherwise("pause")
    return g.withColumn("recommended", state)


def admission_latest(df: DataFrame) -> DataFrame:
    """The newest admission row of each expression: the checks that it failed (joined by a bar), promoted, inserted."""
    checks = F.concat_ws(
        "|",
        F.when(c("corr_to_nearest_target") >= 0.85, F.lit("corr_with_library_max")), F.when(c("mean_turnover") > 0.25, F.lit("daily_turnover")),
        F.when(F.coalesce(c("quick_rank_icir"), F.lit(0.0)) <= 0, F.lit("rank_icir")), F.when(F.coalesce(c("net_sharpe"), F.lit(0.0)) <= 0, F.lit("net_sharpe")),
    )
    rows = df.where("role = 'candidate'").withColumn("_key", bare(c("expression")))
    d = top_n(rows, ["_key"], 1, F.desc("round_id"), F.desc("candidate_id")).withColumn("failed", checks)
    return d.select("family", "expression", "candidate_id", "failed", (c("failed") == "").alias("promoted"), ((c("failed") == "") & c("status").isin(*WINNERS)).alias("inserted"))


def admission_summary(df: DataFrame) -> DataFrame:
    """family, evaluated, promoted, inserted, blocked, and how often each check blocks, as a share of the blocked."""
    a = admission_latest(df)
    blocked = c("failed") != ""
    out = []
    for check in ("corr_with_library_max", "daily_turnover"):
        hit = F.count_if(F.array_contains(F.split("failed", r"\|"), check))
        out += [hit.alias(f"{check}_blocks"), F.when(F.count_if(blocked) > 0, hit / F.count_if(blocked)).alias(f"{check}_rate")]
    return a.groupBy("family").agg(F.count("*").alias("evaluated"), F.count_if("promoted").alias("promoted"), F.count_if("inserted").alias("inserted"), F.count_if(blocked).alias("blocked"), *out)


def balanced_sample(df: DataFrame, bucket: str, n: int) -> DataFrame:
    """n rows taken in turn from the buckets, the largest bucket first, the newest row first."""
    w = Window.partitionBy(bucket).orderBy(F.desc("candidate_id"))
    sizes = df.groupBy(bucket).agg(F.count("*").alias("_size"))
    t = df.withColumn("turn", F.row_number().over(w)).where(c("turn") <= n).join(sizes, bucket)
    return t.orderBy("turn", F.desc("_size"), bucket).limit(n).select("candidate_id", bucket, "turn")
