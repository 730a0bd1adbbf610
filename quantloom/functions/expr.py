"""Factor expressions: trees of column builders over a (dt, instrument) panel.

A node knows its SQL for Spark and, where the words differ, for DuckDB (the tests' oracle). Nothing is
evaluated here; plans.stages turns many trees into few projections with shared sub-expressions.

Missing is null everywhere. Windows count rows of the dense grid. Unless said otherwise a window's result
is null until all its cells are present.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

EPS = "1e-12"


@dataclass(frozen=True, eq=False)
class Expr:
    """kind: field, elem (row by row), ts (one instrument's rows), cs (one date's rows), rec (recursive in time)."""

    kind: str
    args: tuple[Expr, ...]
    spark: str
    duck: str
    bool_: bool = False
    #: A rank within the date, of the only argument.
    rank: bool = False
    #: The window as a function of plans.rolling: its name, the rows it looks at (back), and more.
    roll: tuple = ()

    @property
    def key(self) -> str:
        cached = self.__dict__.get("_key")
        if cached is None:
            cached = f"{self.kind}|{self.spark}|" + "|".join(a.key for a in self.args)
            object.__setattr__(self, "_key", cached)
        return cached

    def __add__(self, o):
        return add(self, o)

    def __radd__(self, o):
        return add(o, self)

    def __sub__(self, o):
        return sub(self, o)

    def __rsub__(self, o):
        return sub(o, self)

    def __mul__(self, o):
        return mul(self, o)

    def __rmul__(self, o):
        return mul(o, self)

    def __truediv__(self, o):
        return div(self, o)

    def __rtruediv__(self, o):
        return div(o, self)

    def __neg__(self):
        return neg(self)

    def __pow__(self, o):
        return power(self, o)

    def __gt__(self, o):
        return gt(self, o)

    def __lt__(self, o):
        return lt(self, o)

    def __ge__(self, o):
        return ge(self, o)

    def __le__(self, o):
        return le(self, o)

    def __and__(self, o):
        return and_(self, o)

    def __or__(self, o):
        return or_(self, o)

    def __invert__(self):
        return not_(self)


Value = Expr | float | int


def field(name: str) -> Expr:
    return Expr("field", (), name, name)


def lit(x: float | int | Expr) -> Expr:
    if isinstance(x, Expr):
        return x
    text = f"CAST({float(x)!r} AS DOUBLE)"
    return Expr("elem", (), text, text)


def node(kind: str, args: Sequence[Value], spark: str, duck: str | None = None, bool_: bool = False, roll: tuple = ()) -> Expr:
    return Expr(kind, tuple(lit(a) for a in args), spark, duck or spark, bool_, roll=roll)


def elem(spark: str, *args: Value, duck: str | None = None, bool_: bool = False) -> Expr:
    return node("elem", args, spark, duck, bool_)


# --- row by row ---------------------------------------------------------------------------------------


def num(x: Value) -> Expr:
    """A condition as 1.0 or 0.0; numbers stay."""
    x = lit(x)
    return elem("CASE WHEN {0} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END", x) if x.bool_ else x


def truth(x: Value) -> Expr:
    """A number as a condition: true unless it is 0; missing is false."""
    x = lit(x)
    return x if x.bool_ else elem("coalesce({0} <> 0, false)", x, bool_=True)


def add(a, b):
    return elem("({0} + {1})", num(a), num(b))


def sub(a, b):
    return elem("({0} - {1})", num(a), num(b))


def mul(a, b):
    return elem("({0} * {1})", num(a), num(b))


def div(a, b):
    """Missing where the divisor is 0."""
    return elem("try_divide({0}, {1})", num(a), num(b), duck="({0} / nullif({1}, 0))")


def neg(x):
    return elem("(- {0})", num(x))


def _compare(op: str, missing: str = "false"):
    def made(a, b):
        return elem(f"coalesce({{0}} {op} {{1}}, {missing})", num(a), num(b), bool_=True)

    return made


gt, lt, ge, le, eq = (_compare(op) for op in (">", "<", ">=", "<=", "="))
ne = _compare("<>", "true")


def and_(a, b):
    return elem("({0} AND {1})", truth(a), truth(b), bool_=True)


def or_(a, b):
    return elem("({0} OR {1})", truth(a), truth(b), bool_=True)


def not_(a):
    return elem("(NOT {0})", truth(a), bool_=True)


def where(cond, x, y):
    return elem("CASE WHEN {0} THEN {1} ELSE {2} END", truth(cond), num(x), num(y))


def indicator(cond):
    return num(truth(cond))


def abs_(x):
    return elem("abs({0})", num(x))


def sign(x):
    return elem("CAST(sign({0}) AS DOUBLE)", num(x))


def log(x):
    """ln of the value, or of 1e-12 below that."""
    return elem(f"CASE WHEN {{0}} IS NOT NULL THEN ln(greatest({{0}}, {EPS})) END", num(x))


def slog1p(x):
    return elem("(sign({0}) * ln(1 + abs({0})))", num(x))


def inv(x):
    return elem(f"CASE WHEN abs({{0}}) > {EPS} THEN 1 / {{0}} END", num(x))


def sqrt(x):
    return elem("CASE WHEN {0} IS NOT NULL THEN sqrt(greatest({0}, 0)) END", num(x))


def power(x, p):
    """Missing where the result is not a finite number. Exponents that are columns go to plans.rolling.c_pow."""
    v = "pow({0}, {1})"
    spark = f"CASE WHEN {{0}} = 0 AND {{1}} < 0 THEN NULL WHEN isnan({v}) OR abs({v}) = double('infinity') THEN NULL ELSE {v} END"
    return elem(
        "c_pow({0}, {1})" if isinstance(p, Expr) else spark,
        num(x),
        num(p),
        duck="CASE WHEN {0} = 0 AND {1} < 0 THEN NULL WHEN {0} < 0 AND {1} <> round({1}) THEN NULL WHEN NOT isfinite(pow({0}, {1})) THEN NULL ELSE pow({0}, {1}) END",
    )


def signed_power(x, p):
    return mul(sign(x), power(abs_(x), p))


def greater(a, b):
    """The larger of two; missing if either is."""
    return elem("CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END", num(a), num(b))


def less(a, b):
    return elem("CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END", num(a), num(b))


def fill(x, value):
    """Missing replaced by a value."""
    return elem("coalesce({0}, {1})", num(x), num(value))


def only(cond, x):
    """x where the condition holds, else missing."""
    return elem("CASE WHEN {0} THEN {1} END", truth(cond), num(x))


def upper_shadow(open_, high, close, preclose):
    return div(sub(high, greater(open_, close)), preclose)


# --- one date, all instruments --------------------------------------------------------------------------

_BY_DATE = "OVER (PARTITION BY dt)"


def cs(spark: str, *args: Value, duck: str | None = None) -> Expr:
    return node("cs", [num(a) for a in args], spark, duck)


def near(x):
    """Computed values to 33 binary digits, whatever their size, so that noise in the last ones makes no order. Fields stay exact."""
    x = num(x)
    if x.kind == "field":
        return x
    k = "CAST(1048577 AS DOUBLE)"
    return elem(f"CASE WHEN abs({{0}}) < 1e300 THEN {{0}} * {k} - ({{0}} * {k} - {{0}}) ELSE {{0}} END", x)


def cs_rank(x):
    """Least rank among ties over the number present; values that agree to ten significant digits are ties."""
    text = "CASE WHEN {0} IS NOT NULL THEN CAST(rank() OVER (PARTITION BY dt ORDER BY {0} ASC NULLS LAST) AS DOUBLE) / count({0}) OVER (PARTITION BY dt) END"
    return Expr("cs", (near(x),), text, text, rank=True)


def cs_mean(x):
    return cs(f"avg({{0}}) {_BY_DATE}", x)


def cs_sum(x):
    return cs(f"coalesce(sum({{0}}) {_BY_DATE}, 0)", x)


def cs_std(x, ddof: int = 0):
    return cs(f"{'stddev_pop' if ddof == 0 else 'stddev_samp'}({{0}}) {_BY_DATE}", x)


def cs_zscore(x):
    s = cs_std(x, 1)
    return elem(f"CASE WHEN {{2}} > {EPS} THEN ({{0}} - {{1}}) / {{2}} END", num(x), cs_mean(x), s)


def cs_max(x):
    return cs(f"max({{0}}) {_BY_DATE}", x)


def cs_min(x):
    return cs(f"min({{0}}) {_BY_DATE}", x)


def cs_count(x):
    return cs(f"CAST(count({{0}}) {_BY_DATE} AS DOUBLE)", x)


def cs_skew(x):
    """Third central moment over the second's 1.5th power; 0 for a flat date; at least three values."""
    x = num(x)
    m = cs_mean(x)
    d = sub(x, m)
    m2, m3 = cs_mean(mul(d, d)), cs_mean(mul(mul(d, d), d))
    return elem(f"CASE WHEN {{2}} < 3 THEN NULL WHEN {{0}} <= {EPS} THEN 0.0 ELSE {{1}} / pow({{0}}, 1.5) END", m2, m3, cs_count(x))


def cs_quantile(x, q: float):
    return cs(f"percentile({{0}}, {q}) {_BY_DATE}", x, duck=f"quantile_cont({{0}}, {q}) {_BY_DATE}")


def scale(x, k: float = 1.0, axis: str = "time"):
    """k * x over the sum of |x|: of the instrument's whole history (axis time, which looks ahead) or of the date."""
    x = num(x)
    total = ts("sum(abs({0})) OVER (PARTITION BY instrument)", x) if axis == "time" else cs(f"sum(abs({{0}})) {_BY_DATE}", x)
    return div(mul(x, k), total)


def indneutralize(x, group: str = "industry"):
    """x minus its group's mean on the date; a missing group is one group."""
    return sub(x, cs(f"avg({{0}}) OVER (PARTITION BY dt, coalesce({group}, 'UNKNOWN'))", x))


def cs_reg_resid(y, x, min_obs: int = 20):
    """Residual of the date's regression of y on x (with intercept), over rows that have both."""
    both = elem("{0} IS NOT NULL AND {1} IS NOT NULL", num(y), num(x), bool_=True)
    a, b = only(both, y), only(both, x)
    my, mx, n = cs_mean(a), cs_mean(b), cs_count(a)
    sxy, sxx = cs_sum(mul(sub(a, my), sub(b, mx))), cs_sum(mul(sub(b, mx), sub(b, mx)))
    return elem(f"CASE WHEN {{6}} >= {min_obs} AND {{5}} > {EPS} THEN ({{0}} - {{2}}) - {{4}} / {{5}} * ({{1}} - {{3}}) END", a, b, my, mx, sxy, sxx, n)


def cs_multi_reg_resid(y, *xs, min_obs: int = 20):
    """Residual of the date's regression of y on several columns, by taking each one out of all that follow."""
    all_ = truth(elem(" AND ".join(f"{{{i}}} IS NOT NULL" for i in range(len(xs) + 1)), num(y), *[num(x) for x in xs], bool_=True))
    n = cs_count(only(all_, y))

    def centred(v):
        return sub(v, cs_mean(v))

    cols = [centred(only(all_, v)) for v in (*xs, y)]
    for k in range(len(xs)):
        e = cols[k]
        square = cs_sum(mul(e, e))
        for j in range(k + 1, len(cols)):
            cols[j] = elem(f"CASE WHEN {{2}} > {EPS} THEN {{0}} - {{1}} / {{2}} * {{3}} ELSE {{0}} END", cols[j], cs_sum(mul(cols[j], e)), square, e)
    return elem(f"CASE WHEN {{1}} >= {min_obs} THEN {{0}} END", cols[-1], n)


# --- one instrument, the last w rows of the grid ----------------------------------------------------------


def frame(w: int, last: int = 0) -> str:
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN {w - 1 + last} PRECEDING AND {end})"


_ORDERED = "OVER (PARTITION BY instrument ORDER BY dt)"


def ts(spark: str, *args: Value, duck: str | None = None, roll: tuple = ()) -> Expr:
    return node("ts", [num(a) for a in args], spark, duck, roll=roll)


def full(w: int, spark: str, *args: Value, duck: str | None = None, roll: tuple = ()) -> Expr:
    """A framed aggregate that needs all w cells of its first argument."""
    gate = f"CASE WHEN count({{0}}) {frame(w)} = {w} THEN %s END"
    return ts(gate % spark, *args, duck=gate % (duck or spark), roll=roll)


def position() -> Expr:
    """The row's number in its instrument's grid, from 1."""
    return ts(f"CAST(row_number() {_ORDERED} AS DOUBLE)")


def delay(x, n: int = 1):
    return ts(f"{'lag' if n >= 0 else 'lead'}({{0}}, {abs(n)}) {_ORDERED}", x, roll=("lag", n) if n > 0 else ()) if n else num(x)


def delta(x, n: int = 1):
    return sub(x, delay(x, n))


def ts_sum(x, w):
    return full(w, f"sum({{0}}) {frame(w)}", x, roll=("sum", w))


def ts_mean(x, w):
    return full(w, f"avg({{0}}) {frame(w)}", x, roll=("mean", w))


def ts_std(x, w):
    return full(w, f"stddev_samp({{0}}) {frame(w)}", x, roll=("std", w)) if w > 1 else only(lt(1, 0), x)


def ts_var(x, w):
    s = ts_std(x, w)
    return mul(s, s)


def ts_ir(x, w):
    return div(ts_mean(x, w), ts_std(x, w))


def ts_max(x, w):
    return full(w, f"max({{0}}) {frame(w)}", x, roll=("max", w))


def ts_min(x, w):
    return full(w, f"min({{0}}) {frame(w)}", x, roll=("min", w))


def ts_med(x, w):
    return ts_quantile(x, w, 0.5)


def ts_quantile(x, w, q):
    # the window's cells sorted, and the point between the two that the share lies between
    cells, at = f"sort_array(collect_list({{0}}) {frame(w)})", (w - 1) * q
    low, high = int(at), math.ceil(at)
    value = f"{cells}[{low}]" if low == high else f"({high} - {at!r}D) * {cells}[{low}] + ({at!r}D - {low}) * {cells}[{high}]"
    return full(w, value, x, duck=f"quantile_cont({{0}}, {q}) {frame(w)}", roll=("quantile", w, low, high, at))


def ts_skew(x, w):
    """Bias-corrected skewness."""
    if w < 3:
        raise ValueError("skewness needs a window of 3 or more")
    return full(w, f"CASE WHEN stddev_samp({{0}}) {frame(w)} > {EPS} THEN skewness({{0}}) {frame(w)} * {(w * (w - 1)) ** 0.5 / (w - 2)!r} END", x, duck=f"CASE WHEN stddev_samp({{0}}) {frame(w)} > {EPS} THEN skewness({{0}}) {frame(w)} END")


def ts_kurt(x, w):
    """Bias-corrected excess kurtosis."""
    if w < 5:
        raise ValueError("kurtosis needs a window of 5 or more")
    return full(w, f"CASE WHEN stddev_samp({{0}}) {frame(w)} > {EPS} THEN {(w - 1) / ((w - 2) * (w - 3))!r} * ({w + 1} * (kurtosis({{0}}) {frame(w)}) + 6) END", x, duck=f"CASE WHEN stddev_samp({{0}}) {frame(w)} > {EPS} THEN kurtosis({{0}}) {frame(w)} END")


def ts_mad(x, w):
    """Mean absolute deviation from the window's mean."""
    cells = f"named_struct('a', collect_list({{0}}) {frame(w)}, 'm', avg({{0}}) {frame(w)})"
    terms = " + ".join(f"abs(lag({{0}}, {i}) {_ORDERED} - avg({{0}}) {frame(w)})" for i in range(w))
    return full(w, f"transform(array({cells}), t -> aggregate(t.a, CAST(0 AS DOUBLE), (s, v) -> s + abs(v - t.m)) / {w})[0]", x, duck=f"({terms}) / {w}")


def ts_count(x, w):
    """Values present, from the w-th row of the grid on."""
    return ts(f"CASE WHEN count(*) {frame(w)} = {w} THEN CAST(count({{0}}) {frame(w)} AS DOUBLE) END", x)


def count_true(cond, w):
    return ts_sum(indicator(cond), w)


def sumif(x, w, cond):
    return ts_sum(where(cond, x, 0.0), w)


def product(x, w):
    return full(w, f"aggregate(collect_list({{0}}) {frame(w)}, CAST(1 AS DOUBLE), (p, v) -> p * v)", x, duck=f"product({{0}}) {frame(w)}")


def ts_max_diff(x, w):
    return sub(x, ts_max(x, w))


def ts_min_diff(x, w):
    return sub(x, ts_min(x, w))


def ts_min_max_diff(x, w):
    return sub(ts_max(x, w), ts_min(x, w))


def ts_argmax(x, w):
    """Place of the greatest cell, 1 for the oldest; the first on ties (as in ts_rank)."""
    return full(w, f"CAST(array_position(collect_list({{0}}) {frame(w)}, max({{0}}) {frame(w)}) AS DOUBLE)", near(x), duck=f"CAST(list_position(list({{0}}) {frame(w)}, max({{0}}) {frame(w)}) AS DOUBLE)", roll=("argmax", w))


def ts_argmin(x, w):
    return full(w, f"CAST(array_position(collect_list({{0}}) {frame(w)}, min({{0}}) {frame(w)}) AS DOUBLE)", near(x), duck=f"CAST(list_position(list({{0}}) {frame(w)}, min({{0}}) {frame(w)}) AS DOUBLE)", roll=("argmin", w))


def highday(x, w):
    return sub(w + 1, ts_argmax(x, w))


def lowday(x, w):
    return sub(w + 1, ts_argmin(x, w))


def ts_rank(x, w):
    """1 + the number of cells below the newest; values that agree to ten significant digits are equal."""
    x = near(x)
    below = " + ".join(f"(CASE WHEN lag({{0}}, {i}) {_ORDERED} < {{0}} THEN 1 ELSE 0 END)" for i in range(1, w)) or "0"
    return full(w, f"CAST(size(filter(collect_list({{0}}) {frame(w)}, v -> v < {{0}})) + 1 AS DOUBLE)", x, duck=f"CAST({below} + 1 AS DOUBLE)", roll=("rank", w))


def weighted(x, weights: Sequence[float]):
    """Sum of weights[i] * the value i rows back; all must be present."""
    return ts(" + ".join(f"{float(v)!r} * (lag({{0}}, {i}) {_ORDERED})" if i else f"{float(v)!r} * {{0}}" for i, v in enumerate(weights)), x, roll=("weighted", len(weights), *map(float, weights)))


def decay_linear(x, w):
    """Weights 1..w, the newest heaviest."""
    return div(weighted(x, [w - i for i in range(w)]), w * (w + 1) / 2 + 1e-12)


def wma(x, w):
    weights = [0.9**i for i in range(w)]
    return div(weighted(x, weights), sum(weights) + 1e-12)


def weighted_mean(x, w, half_life: float = 0):
    """Weights halving every half_life rows (all 1 if it is 0), over w."""
    return div(weighted(x, [0.5 ** (i / half_life) if half_life > 0 else 1.0 for i in range(w)]), w)


def ts_exp_weighted_mean_lagged(x, w):
    """The w rows before this one, weights (1 - 2 / (1 + w)) ** i, missing as 0, over w; at least one present."""
    a = 2 / (1 + w)
    total = " + ".join(f"{(1 - a) ** (i - 1)!r} * coalesce(lag({{0}}, {i}) {_ORDERED}, 0)" for i in range(1, w + 1))
    return ts(f"CASE WHEN count({{0}}) {frame(w, 1)} > 0 THEN ({total}) / {w} END", x)


def volume_weighted_mean(x, v, w):
    both = elem("{0} IS NOT NULL AND {1} IS NOT NULL", num(x), num(v), bool_=True)
    total = ts_sum(only(both, v), w)
    return elem(f"CASE WHEN {{1}} > {EPS} THEN {{0}} / {{1}} END", ts_sum(mul(x, v), w), total)


def _pair(x, y):
    x, y = num(x), num(y)
    both = elem("{0} IS NOT NULL AND {1} IS NOT NULL", x, y, bool_=True)
    return only(both, x), only(both, y)


def _moments(x, y, w):
    x, y = _pair(x, y)
    return x, y, ts_mean(x, w), ts_mean(y, w)


def _co_moment(w: int, value: str) -> str:
    """value, or 0 where the window's covariance is no more than noise beside the two deviations."""
    noise = f"1e-12 * (stddev_samp({{0}}) {frame(w)}) * (stddev_samp({{1}}) {frame(w)})"
    return f"CASE WHEN abs(covar_samp({{0}}, {{1}}) {frame(w)}) <= {noise} THEN CAST(0 AS DOUBLE) ELSE {value} END"


def ts_cov(x, y, w):
    x, y = _pair(x, y)
    return full(w, _co_moment(w, f"covar_samp({{0}}, {{1}}) {frame(w)}"), x, y, roll=("cov", w))


def ts_corr(x, y, w):
    """From the w-th row of the grid on, a window that lacks a pair gives 0."""
    x, y = _pair(x, y)
    value = f"(covar_samp({{0}}, {{1}}) {frame(w)}) / ((stddev_samp({{0}}) {frame(w)}) * (stddev_samp({{1}}) {frame(w)}) + {EPS})"
    return ts(f"CASE WHEN count(*) {frame(w)} < {w} THEN NULL WHEN count({{0}}) {frame(w)} < {w} THEN 0.0 ELSE {_co_moment(w, value)} END", x, y, roll=("corr", w))


def _trend(x, w):
    """Slope over 0..w-1 as weights of the cells: sum of (age from the middle) * x over the sum of squares."""
    mid = (w - 1) / 2
    square = sum((i - mid) ** 2 for i in range(w))
    return div(weighted(x, [mid - i for i in range(w)]), square + 1e-12)


def slope(x, w):
    return _trend(x, w)


regbeta = slope


def resi(x, w):
    """The newest value minus the fitted line."""
    return sub(sub(x, ts_mean(x, w)), mul(_trend(x, w), (w - 1) / 2))


def rsquare(x, w):
    """1 - residual over total sum of squares; a flat window gives 1."""
    x = num(x)
    sst = mul(ts_var(x, w), w - 1)
    b = _trend(x, w)
    square = sum((i - (w - 1) / 2) ** 2 for i in range(w))
    ssr = greater(sub(sst, mul(mul(b, b), square)), 0)
    return sub(1, div(ssr, add(sst, 1e-12)))


def regression_slope(y, x, w):
    return div(ts_cov(y, x, w), add(ts_var(_pair(x, y)[0], w), 1e-12))


def regression_rsq(y, x, w):
    c = ts_cov(y, x, w)
    a, b = _pair(x, y)
    return div(mul(c, c), add(mul(ts_var(a, w), ts_var(b, w)), 1e-12))


def regression_residual(y, x, w):
    a, b = _pair(y, x)
    return sub(sub(a, ts_mean(a, w)), mul(regression_slope(y, x, w), sub(b, ts_mean(b, w))))


def ts_pct_change(x, n: int = 1):
    return sub(div(x, delay(x, n)), 1)


def wide_returns(x):
    return ts_pct_change(x, 1)


def _sorted_cells(key, x, w) -> tuple[str, str, Expr, Expr]:
    """The window's (key, age from the oldest, x), by key and then by age."""
    key, x = _pair(key, x)
    pos = position()
    spark = f"array_sort(collect_list(named_struct('k', {{0}}, 'p', {{2}}, 'x', {{1}})) {frame(w)})"
    duck = f"list_sort(list(struct_pack(k := {{0}}, p := {{2}}, x := {{1}})) {frame(w)})"
    return spark, duck, key, x


def bucket_sum(x, key, w, q, side: str):
    """Sum of x over the window's rows whose key's percentile rank is at most q (low) or at least 1 - q (high)."""
    if not 0 < q <= 0.5:
        raise ValueError("q must be above 0 and at most 0.5")
    spark, duck, key, x = _sorted_cells(key, x, w)
    # rank i of 1..w is i / w
    if side == "low":
        first, last = 1, max(0, int(q * w + 1e-9))
    else:
        first, last = next(i for i in range(1, w + 1) if i / w >= 1 - q - 1e-12), w
    n = last - first + 1
    if n <= 0:
        return full(w, "0.0", key)
    return full(w, f"aggregate(slice({spark}, {first}, {n}), CAST(0 AS DOUBLE), (s, v) -> s + v.x)", key, x, position(), duck=f"list_sum(list_transform(({duck})[{first}:{last}], lambda v: v.x))", roll=("bucket", w, first, n))


def ts_sorted_mean_spread(x, key, w, ratio):
    """Mean of x on the rows with the greatest keys minus that on the rows with the least (ratio * w rows each)."""
    spark, duck, key, x = _sorted_cells(key, x, w)
    n = max(1, int(w * ratio))
    top = f"aggregate(slice({spark}, {w - n + 1}, {n}), CAST(0 AS DOUBLE), (s, v) -> s + v.x)"
    low = f"aggregate(slice({spark}, 1, {n}), CAST(0 AS DOUBLE), (s, v) -> s + v.x)"
    return full(w, f"({top} - {low}) / {n}", key, x, position(), duck=f"(list_sum(list_transform(({duck})[{w - n + 1}:{w}], lambda v: v.x)) - list_sum(list_transform(({duck})[1:{n}], lambda v: v.x))) / {n}", roll=("spread", w, n))


def ts_turnover_ref_price(close, turnover, w):
    """Reference price: a day weighs its turnover times the share not traded on later days, normalised.

    From the oldest day on, what is held keeps the share that the next day doesn't trade and that day's part is added, so
    the text is as long for any window. DuckDB: the weights written out.
    """
    close, turnover = _pair(close, turnover)
    held = "named_struct('p', s.p * (1 - v.t) + v.t * v.x, 'q', s.q * (1 - v.t) + v.t)"
    cells = f"collect_list(named_struct('t', {{1}}, 'x', {{0}})) {frame(w)}"
    fold = f"aggregate({cells}, named_struct('p', CAST(0 AS DOUBLE), 'q', CAST(0 AS DOUBLE)), (s, v) -> {held}, s -> CASE WHEN abs(s.q) > {EPS} THEN s.p / s.q END)"
    rest, top, bottom = "1.0", [], []
    for i in range(w):
        t = f"(lag({{1}}, {i}) {_ORDERED})"
        top.append(f"{rest} * {t} * (lag({{0}}, {i}) {_ORDERED})")
        bottom.append(f"{rest} * {t}")
        rest = f"{rest} * (1 - {t})"
    return full(w, fold, close, turnover, duck=f"CASE WHEN abs({' + '.join(bottom)}) > {EPS} THEN ({' + '.join(top)}) / ({' + '.join(bottom)}) END" if w <= 40 else "NULL")


def adv(volume, n):
    return ts_mean(volume, n)


def relative(x, n):
    """x over its mean of n rows."""
    return div(x, ts_mean(x, n))


def cntp_mean(cond, w):
    return ts_mean(indicator(cond), w)


# --- recursive in time ------------------------------------------------------------------------------------


def recursive(x, alpha: float, least: int = 1) -> Expr:
    """Exponential mean v += alpha * (x - v) from the first value on; missing rows age the old value's weight.

    Missing until `least` values have been seen. Spark runs it as one ordered pass for each instrument.
    """
    a = repr(float(alpha))
    # DuckDB: the same pass as a fold over the rows so far; a leading struct is the state
    steps = f"list(struct_pack(v := CAST({{0}} AS DOUBLE), g := CAST(1 AS DOUBLE))) OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fold = (
        f"list_reduce({steps}, lambda s, e: struct_pack(v := CASE WHEN e.v IS NULL THEN s.v WHEN s.v IS NULL THEN e.v ELSE (s.g * (1 - {a}) * s.v + {a} * e.v) / (s.g * (1 - {a}) + {a}) END, "
        f"g := CASE WHEN s.v IS NULL OR e.v IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE s.g * (1 - {a}) END)).v"
    )
    gate = f"CASE WHEN count({{0}}) OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= {least} THEN %s END"
    return node("rec", [num(x)], f"{a},{least}", gate % fold)


def ema(x, span, least: int = 1):
    return recursive(x, 2 / (span + 1), least)


def macd(x, fast, slow):
    return sub(ema(x, fast, fast), ema(x, slow, slow))


def sma(x, n, m):
    return recursive(x, m / n)
