"""Text features of factor expressions: patterns over the expression column, no parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators.settle import first_kept
from quantloom.sources.shared import Tables

# Names of fields, tags, groups of tokens, usual windows, known names.
FIELDS = ("open", "high", "low", "close", "volume", "vwap", "pre_close", "amount", "turnover", "pct_chg", "is_st", "trade_status", "returns", "benchmark_open", "benchmark_close", "market_return", "cap", "size", "float_market_cap", "smb", "hml")
TAGS = ("amount", "volume", "turnover", "ema", "decay_linear", "ts_mean", "ts_std", "ts_rank", "cs_rank", "corr", "ts_corr", "cov", "ts_cov", "rel_amount", "rel_volume", "bucket_sum", "where", "if_then_else")
RANKS = ("ts_rank", "cs_rank", "rank")
SMOOTHERS = ("ema", "decay_linear")
SPREADS = ("ts_std", "std")
CONDITIONS = ("where", "if_then_else", "bucket_sum")
RELATIVES = ("rel_amount", "rel_volume")
LIQUIDITY = ("amount", "volume", "turnover", "rel_amount", "rel_volume")
PRICES = ("open", "close", "high", "low", "vwap", "returns")
WINDOWS = (3, 5, 10, 14, 15, 20, 28, 40, 60, 100, 120, 180, 250, 375)
#: Economic families in order, each with the tokens that show it.
FAMILIES = (
    ("volume_liquidity", ("amount", "volume", "turnover")),
    ("price_structure", ("returns", "open", "close", "high", "low", "vwap")),
    ("smoothing", SMOOTHERS),
    ("volatility_normalization", SPREADS),
    ("ranking", RANKS),
    ("relative_participation", RELATIVES),
    ("conditional_state", CONDITIONS),
)
OPERATORS = (
    "add", "sub", "mul", "div", "gt", "lt", "ge", "le", "eq", "ne", "and", "or", "not", "neg", "where", "if_then_else", "rank", "zscore", "cs_mean", "cs_sum", "cs_std", "cs_skew",
    "cs_rank", "cs_zscore", "ts_var", "ts_ir", "ts_skew", "ts_kurt", "ts_rank", "corr", "ts_corr", "cov", "ts_cov", "std", "ts_std", "mean", "ts_mean", "sma", "wma", "product",
    "sum", "ts_sum", "ts_count", "ts_med", "ts_mad", "count", "sumif", "bucket_sum", "max", "ts_max", "min", "ts_min", "delay", "ref", "delta", "ts_pct_change", "ema",
    "decay_linear", "ts_linear_decay_mean", "ts_exp_weighted_mean_lagged", "weighted_mean", "volume_weighted_mean", "ts_turnover_ref_price", "ts_sorted_mean_spread",
    "rolling_cs_spearman_mean", "cs_reg_resid", "cs_multi_reg_resid", "ts_argmax", "ts_argmin", "ts_quantile", "ts_max_diff", "ts_min_diff", "ts_min_max_diff", "scale", "abs",
    "sign", "log", "slog1p", "inv", "sqrt", "power", "rowmax", "rowmin", "greater", "less", "highday", "lowday", "upper_shadow", "macd", "regbeta", "regression_slope",
    "regression_rsq", "regression_residual", "slope", "rsquare", "resi", "rel_volume", "rel_amount", "sector", "turnover_rate", "midprice",
)
OTHER_NAMES = ("adv20", "industry", "subindustry", "indneutralize", "true", "false", "nan", "half_life", "min_obs")
KEYWORDS = ("half_life", "min_obs")

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_NUMBER = r"(?<![A-Za-z_])(\d+(?:\.\d+)?)(?![A-Za-z_])"


def _list(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _any(tokens: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens, _list(names))


def normalized(expression: Column) -> Column:
    """Without enclosing angle brackets, ^ as **, calls of and, or, not as logical_*."""
    x = F.trim(F.coalesce(expression, F.lit("")))
    x = F.when(x.startswith("<") & x.endswith(">"), F.trim(F.regexp_replace(x, r"^<|>$", ""))).otherwise(x)
    return F.regexp_replace(F.replace(x, F.lit("^"), F.lit("**")), r"\b(and|or|not)(\s*\()", "logical_$1$2")


def bare(expression: Column) -> Column:
    """The normalised text in lower case without blanks: equal texts count as the same expression."""
    return F.lower(F.regexp_replace(normalized(expression), r"\s", ""))


def tokens(expression: Column) -> Column:
    """Distinct names in the text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(expression, F.lit(""))), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)))


def operators(expression: Column) -> Column:
    """Operator names in the order of their calls."""
    return F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(rf"({_NAME})\("), F.lit(1))


def required_fields(expression: Column) -> Column:
    """Fields that the text needs, sorted: those it names (preclose is pre_close), and those that derived names stand for."""
    t = F.transform(tokens(normalized(expression)), lambda x: F.when(x == "preclose", "pre_close").otherwise(x))
    has = lambda *names: _any(t, names)
    implied = [
        F.when(has("midprice"), _list(("high", "low"))),
        F.when(has("turnover_rate"), _list(("turnover",))),
        F.when(has("ts_turnover_ref_price"), _list(("close", "turnover"))),
        F.when(has("rel_volume") | F.exists(t, lambda x: x.rlike(r"^adv\d+$")), _list(("volume",))),
        F.when(has("rel_amount"), _list(("amount",))),
    ]
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(F.array_intersect(t, _list(FIELDS)), *implied)))))


def windows(expression: Column) -> Column:
    """Whole numbers in the text, sorted, repeats kept."""
    found = F.regexp_extract_all(bare(expression), F.lit(_NUMBER), F.lit(1))
    return F.array_sort(F.transform(F.filter(found.cast("array<double>"), lambda x: x == F.floor(x)), lambda x: x.cast("int")))


def skeleton(expression: Column) -> Column:
    """The bare text with <F> for fields, <ADV> for average volumes and <N> for numbers."""
    names = "|".join(sorted(FIELDS, key=lambda f: (-len(f), f)))
    x = F.regexp_replace(bare(expression), rf"(?<![a-z0-9_])({names})(?![a-z0-9_])", "<F>")
    return F.regexp_replace(F.regexp_replace(x, r"adv\d+", "<ADV>"), _NUMBER, "<N>")


def window_tokens(expression: Column) -> Column:
    """The usual windows that the text names, distinct, as text in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(r"\b(?:" + "|".join(map(str, WINDOWS)) + r")\b"), F.lit(0))))


def expression_tags(expression: Column) -> Column:
    """Tags of the vocabulary that the text names, then the compound ones."""
    t = tokens(expression)
    named = F.array_intersect(_list(TAGS), t)
    both = lambda *names: F.size(F.array_intersect(t, _list(names))) == len(names)
    compound = F.array(F.when(both("ts_std", "amount"), F.lit("amount_std_normalization")), F.when(both("ts_std", "turnover"), F.lit("turnover_std_normalization")), F.when(both("ema"), F.lit("smoothing")))
    return F.concat(named, F.array_compact(compound))


def operator_skeleton(expression: Column) -> Column:
    """The first five operators, ts_ as ts: and cs_ as cs:, joined by a bar; `literal` without any."""
    marked = F.transform(F.slice(operators(expression), 1, 5), lambda x: F.regexp_replace(F.lower(x), "^(ts|cs)_", "$1:"))
    return F.when(F.size(marked) > 0, F.array_join(marked, "|")).otherwise("literal")


def motif(expression: Column) -> Column:
    """The first three operators; `literal` without any."""
    ops = F.slice(operators(expression), 1, 3)
    return F.when(F.size(ops) > 0, F.array_join(ops, ">")).otherwise("literal")


def economic_tags(expression: Column) -> Column:
    """Economic families that a token of the text shows, in order; `generic` if none does."""
    t = tokens(expression)
    tags = F.array_compact(F.array(*[F.when(_any(t, names), F.lit(tag)) for tag, names in FAMILIES]))
    return F.when(F.size(tags) > 0, tags).otherwise(_list(("generic",)))


def depth(expression: Column) -> Column:
    """Greatest depth of parentheses; one that closes too many counts for nothing."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, ch: Column) -> Column:
        d = F.greatest(acc.d + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0), F.lit(0))
        return F.struct(d.alias("d"), F.greatest(acc.m, d).alias("m"))

    return F.aggregate(F.split(F.coalesce(expression, F.lit("")), ""), start, step, lambda acc: acc.m)


def complexity(expression: Column) -> Column:
    """Operators + 0.08 * names + 0.18 * depth."""
    names = F.size(F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(_NAME), F.lit(0)))
    return F.size(operators(expression)) + F.lit(0.08) * names + F.lit(0.18) * depth(expression)


def problems(expression: Column) -> Column:
    """Names of the rules that a text fails, in order.

    empty; dotted_reference; keyword_argument (but half_life and min_obs); unusual_window (a whole number
    other than 0, 1 and the usual windows); unknown_name (no operator, field, average volume or upper-case name).
    """
    x = F.trim(F.coalesce(expression, F.lit("")))
    x = F.when(x.startswith("<") & x.endswith(">"), F.trim(F.regexp_replace(x, r"^<|>$", ""))).otherwise(x)
    x = F.regexp_replace(x, r"(?<![A-Za-z_])(?:\d+(?:\.\d*)?|\.\d+)[eE][+-]?\d+", "0")
    named = F.regexp_extract_all(x, F.lit(rf"(?<![<>=!])\b({_NAME})\s*="), F.lit(1))
    whole = F.regexp_extract_all(x, F.lit(r"(?<![A-Za-z_])(\d+)(?![A-Za-z_])"), F.lit(1)).cast("array<bigint>")
    names = F.regexp_extract_all(F.replace(x, F.lit("$")), F.lit(_NAME), F.lit(0))
    known = _list((*OPERATORS, *FIELDS, *OTHER_NAMES))
    unknown = F.exists(names, lambda n: ~F.array_contains(known, F.lower(n)) & ~F.lower(n).rlike(r"^adv\d+$") & ~((F.upper(n) == n) & (F.lower(n) != n)))
    rules = F.array(
        F.when(x.rlike(rf"\b{_NAME}(?:\.{_NAME})+\b"), F.lit("dotted_reference")),
        F.when(F.size(F.array_except(named, _list(KEYWORDS))) > 0, F.lit("keyword_argument")),
        F.when(F.size(F.array_except(whole, F.array(*[F.lit(w).cast("bigint") for w in (0, 1, *WINDOWS)]))) > 0, F.lit("unusual_window")),
        F.when(unknown, F.lit("unknown_name")),
    )
    return F.when(x == "", _list(("empty",))).otherwise(F.array_compact(rules))


def _profile(expression: Column) -> Column:
    """What mutations are told from, as one struct."""
    t = tokens(expression)
    return F.struct(
        F.trim(F.coalesce(expression, F.lit(""))).alias("text"),
        t.alias("names"),
        F.array_sort(F.array_distinct(operators(expression))).alias("calls"),
        window_tokens(expression).alias("windows"),
        F.array_sort(F.array_intersect(t, _list((*LIQUIDITY, *PRICES)))).alias("fields"),
    )


def _shape(p: Column) -> Column:
    """The kind of an expression that has no parent."""
    return (
        F.when(_any(p.names, CONDITIONS), "conditionalization")
        .when(_any(p.names, RANKS), "rank_wrapper")
        .when(_any(p.names, SMOOTHERS), "smoothing_insertion")
        .when(_any(p.names, SPREADS) & _any(p.names, LIQUIDITY), "normalization_insertion")
        .when(_any(p.names, RELATIVES), "relative_reweighting")
        .when(F.size(p.windows) >= 3, "window_rebalancing")
        .otherwise("structural_rewrite")
    )


def _mutation(c: Column, p: Column) -> Column:
    """The first rule that tells a child from its parent (profiles); the shape's kind without a parent."""
    new = F.array_union(F.array_except(c.names, p.names), F.array_except(c.calls, p.calls))
    changed = F.array_union(new, F.array_union(F.array_except(p.names, c.names), F.array_except(p.calls, c.calls)))
    added = lambda names: _any(new, names) & ~_any(p.names, names)
    renamed = F.array_union(F.array_except(c.names, p.names), F.array_except(p.names, c.names))
    moved = c.fields != p.fields
    both_divide = F.array_contains(c.calls, "div") & F.array_contains(p.calls, "div")
    return (
        F.when(c.text == "", "structural_rewrite")
        .when(p.text.isNull() | (p.text == ""), _shape(c))
        .when(c.text == p.text, "identity")
        .when(added(CONDITIONS), "conditional_gate_added")
        .when(added(RANKS), "rank_wrapper_added")
        .when(added(SMOOTHERS), "smoothing_added")
        .when(added(SPREADS), "normalization_added")
        .when(_any(renamed, RELATIVES) | (moved & _any(F.array_union(c.fields, p.fields), LIQUIDITY)), "liquidity_proxy_swap")
        .when((c.calls == p.calls) & ~moved & (c.windows != p.windows), "window_tuning")
        .when(both_divide & _any(changed, (*SPREADS, *SMOOTHERS, *RELATIVES)), "denominator_rewrite")
        .when(moved, "field_proxy_swap")
        .when((c.calls != p.calls) & (c.windows == p.windows), "operator_refactor")
        .otherwise("structural_rewrite")
    )


def featured(df: DataFrame) -> DataFrame:
    e = F.col("expression")
    return df.withColumns({"operators": operators(e), "fields": required_fields(e), "windows": windows(e), "skeleton": skeleton(e)})


def profiled(df: DataFrame) -> DataFrame:
    """Adds motif, operator_skeleton, economic_tags, mutation (against the parent's expression), shape and profile_key."""
    own = df.select(F.col("candidate_id").alias("_id"), F.col("expression").alias("_parent"))
    j = df.join(own, F.col("parent_candidate_id") == F.col("_id"), "left")
    e = F.col("expression")
    j = j.withColumns({"_c": _profile(e), "_p": _profile(F.col("_parent"))})
    j = j.withColumns({"motif": motif(e), "operator_skeleton": operator_skeleton(e), "economic_tags": economic_tags(e), "mutation": _mutation(F.col("_c"), F.col("_p")), "shape": _shape(F.col("_c"))})
    return j.withColumn("profile_key", F.concat_ws("||", "mutation", "operator_skeleton", F.array_join("economic_tags", ","))).drop("_id", "_parent", "_c", "_p")


def first_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def structural_duplicates(df: DataFrame, order: str = "candidate_id", near: int = 5) -> DataFrame:
    """candidate_id, duplicate_of: the first earlier candidate of the same operators and fields whose windows differ by at most `near`.

    Equal window lists are one class, so that a frequent expression makes no pairs; classes of one
    (operators, fields) block are few.
    """
    f = featured(df)
    key = [F.array_join("operators", "|").alias("ops"), F.array_join("fields", "|").alias("flds"), "windows"]
    classes = f.groupBy(*key).agg(F.min(order).alias("first"))
    a, b = classes.alias("a"), classes.alias("b")
    close = F.forall(F.zip_with("a.windows", "b.windows", lambda x, y: F.abs(x - y) <= near), lambda ok: ok)
    near_by = a.join(b, (F.col("a.ops") == F.col("b.ops")) & (F.col("a.flds") == F.col("b.flds")) & (F.size("a.windows") == F.size("b.windows")) & close)
    best = near_by.groupBy(F.col("a.ops").alias("ops"), F.col("a.flds").alias("flds"), F.col("a.windows").alias("windows")).agg(F.min("b.first").alias("earliest"))
    out = f.select(order, *key).join(best, ["ops", "flds", "windows"])
    return out.select(order, F.when(F.col("earliest") < F.col(order), F.col("earliest")).alias("duplicate_of"))


def first_kept_duplicates(df: DataFrame, order: str = "candidate_id", near: int = 5) -> DataFrame:
    """candidate_id, duplicate_of: the first kept candidate that an ordered pass finds a candidate redundant with.

    Two are redundant if fields and skeleton agree, or fields and operators agree and the windows differ by at most
    `near`; only candidates that are redundant with none kept before are kept. Equal skeletons have equal operators. The
    distinct (fields, operators, skeleton, windows) are the items; those of one skeleton are a clique, and pairs of near
    windows meet in cells of the first window.
    """
    tables = Tables()
    key = ["ops", "flds", "skeleton", "windows"]
    f = tables.stored(featured(df).select(F.col(order).cast("long").alias("_order"), F.array_join("operators", "|").alias("ops"), F.array_join("fields", "|").alias("flds"), "skeleton", "windows"), "featured")
    classes = tables.stored(f.groupBy(*key).agg(F.min("_order").alias("first")), "classes")
    width = near + 1
    cell = F.floor(F.element_at("windows", 1) / width)
    sided = classes.where(F.size("windows") > 0).select("ops", "flds", F.size("windows").alias("n"), "windows", "first", cell.alias("cell"))
    other = sided.select(F.col("windows").alias("w"), F.col("first").alias("later"), *[F.col(x).alias(f"_{x}") for x in ("ops", "flds", "n")], F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)])).alias("_cell"))
    met = sided.join(other, (F.col("ops") == F.col("_ops")) & (F.col("flds") == F.col("_flds")) & (F.col("n") == F.col("_n")) & (F.col("cell") == F.col("_cell")) & (F.col("first") < F.col("later")))
    close = met.where(F.forall(F.zip_with("windows", "w", lambda x, y: F.abs(x - y) <= near), lambda ok: ok)).select(F.col("first").alias("earlier"), "later")
    cliques = classes.select(F.col("first").alias("item"), F.concat_ws("\n", "ops", "flds", "skeleton").alias("clique"))
    found = first_kept(close, tables, cliques)
    of = classes.join(found, F.col("first") == F.col("dropped"), "left").select(*[F.col(x).alias(f"_{x}") for x in key], F.coalesce("kept", "first").alias("kept"))
    same = F.lit(True)
    for x in key:
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    return f.join(of, same).select(F.col("_order").alias(order), F.when(F.col("kept") != F.col("_order"), F.col("kept")).alias("duplicate_of"))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """candidate_id, factor_name, matched_id: candidates whose bare expression a kept factor of the family has, from another run.

    Of several kept factors the newest names the match.
    """
    keyed = df.withColumn("_key", bare(F.col("expression")))
    kept = keyed.where(F.col("status").isin("research_winner", "research_keep", "winner", "keep"))
    # the newest kept one of each run, then the newest of the other runs
    by_run = kept.groupBy("family", "_key", "run_id").agg(F.max("candidate_id").alias("newest"))
    best = by_run.groupBy("family", "_key").agg(F.slice(F.sort_array(F.collect_list(F.struct("newest", "run_id")), False), 1, 2).alias("two"))
    j = keyed.where("role = 'candidate'").join(best, ["family", "_key"])
    other = F.filter("two", lambda x: x.run_id != F.col("run_id"))
    return j.where(F.size(other) > 0).select("candidate_id", "factor_name", F.element_at(other, 1).newest.alias("matched_id"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def keywords(expression: Column) -> Column:
    return F.filter(tokens(expression), lambda x: F.length(x) >= 3)


def compared() -> Column:
    """What likeness() compares of a profiled candidate with branch, as one struct."""
    e = F.col("expression")
    return F.struct("branch", "motif", "mutation", "operator_skeleton", "economic_tags", F.array_distinct(operators(e)).alias("calls"), keywords(e).alias("words"))


def likeness(x: Column, y: Column) -> Column:
    """Weighted likeness of two candidates (structs of compared()), at most 1."""
    same = lambda f: F.when(x[f] == y[f], 1.0).otherwise(0.0)
    alike = 0.4 * same("branch") + 0.25 * same("motif") + 0.15 * same("mutation") + 0.2 * same("operator_skeleton")
    return F.least(alike + 0.15 * jaccard(x["economic_tags"], y["economic_tags"]) + 0.2 * jaccard(x["calls"], y["calls"]) + 0.1 * jaccard(x["words"], y["words"]), F.lit(1.0))


def pair_similarity(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity of pairs of candidate ids; df: profiled candidates with branch."""
    made = df.select("candidate_id", compared().alias("x"))
    at = pairs.join(made.select(F.col("candidate_id").alias("a"), F.col("x").alias("xa")), "a").join(made.select(F.col("candidate_id").alias("b"), F.col("x").alias("xb")), "b")
    return at.select("a", "b", likeness(F.col("xa"), F.col("xb")).alias("similarity"))
