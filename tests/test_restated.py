"""Every column operator, and formulas of each catalog, restated in numpy: nothing here reads the operators' SQL."""

import datetime

import numpy as np
import pytest

from quantloom.catalog import bars158, formulaic101, lags360, methods191
from quantloom.functions import expr as X
from quantloom.plans.stages import compute
from quantloom.sources.shared import stored

T, N, EPS = 40, 24, 1e-12
NAN = np.nan
R = np.random.default_rng(12)


def table(gaps, scale=1.0, ties=False):
    x = R.normal(size=(T, N)) * scale
    x = np.round(x, 1) if ties else x
    x[R.random((T, N)) < gaps] = NAN
    return x


#: Fields, dates by instruments: p positive and complete, x and y with gaps, k with ties and few gaps, t a turnover.
FIELDS = {"p": np.exp(table(0, 0.1)) * 10, "x": table(0.1), "y": table(0.1), "k": table(0.02, 1.0, True), "t": np.abs(table(0.02, 0.2)), "v": np.exp(table(0, 0.5)) * 100}
FIELDS |= {"open": FIELDS["p"] * np.exp(table(0, 0.02)), "close": FIELDS["p"], "volume": FIELDS["v"]}
FIELDS["high"] = np.maximum(FIELDS["open"], FIELDS["close"]) * np.exp(np.abs(table(0, 0.02)))
FIELDS["low"] = np.minimum(FIELDS["open"], FIELDS["close"]) * np.exp(-np.abs(table(0, 0.02)))
FIELDS["amount"] = FIELDS["volume"] * FIELDS["close"]
FIELDS["vwap"] = (FIELDS["high"] + FIELDS["low"] + FIELDS["close"]) / 3
p, x, y, k, t, v, o, h, l, c, a, w_ = (X.field(n) for n in ("p", "x", "y", "k", "t", "v", "open", "high", "low", "close", "amount", "vwap"))
A = FIELDS


def windows(w, f, *names, last=0, gaps=False, early=NAN):
    """f of each instrument's last w rows of the fields (all present, unless gaps), from the w-th row on."""
    out = np.full((T, N), early, float)
    for i in range(N):
        for d in range(T):
            lo = d - last - w + 1
            if lo < 0:
                if not gaps:
                    continue
                lo = 0
            cells = [(A[n] if isinstance(n, str) else n)[lo : d - last + 1, i] for n in names]
            if gaps or not any(np.isnan(z).any() for z in cells):
                out[d, i] = f(*cells)
    return out


def dates(f, *names):
    return np.stack([f(*[(A[n] if isinstance(n, str) else n)[d] for n in names]) for d in range(T)])


def shift(z, n):
    out = np.full((T, N), NAN)
    if n >= 0:
        out[n:] = z[: T - n]
    else:
        out[:n] = z[-n:]
    return out


def least_rank(z):
    have = z[~np.isnan(z)]
    return np.array([NAN if np.isnan(q) else (1 + (have < q).sum()) / len(have) for q in z])


def compare(op, missing=0.0):
    both = ~np.isnan(A["x"]) & ~np.isnan(A["y"])
    return np.where(both, op(A["x"], A["y"]).astype(float), missing)


def residual(y_, *xs):
    ok = ~np.isnan(y_)
    for z in xs:
        ok &= ~np.isnan(z)
    out = np.full(N, NAN)
    if ok.sum() >= 5:
        m = np.column_stack([np.ones(ok.sum()), *[z[ok] for z in xs]])
        out[ok] = y_[ok] - m @ np.linalg.lstsq(m, y_[ok], rcond=None)[0]
    return out


def fit(z):
    n = np.arange(len(z))
    b = ((n - n.mean()) * (z - z.mean())).sum() / (((n - n.mean()) ** 2).sum() + EPS)
    return b, z.mean() - b * n.mean()


def skewness(z):
    n, d = len(z), z - z.mean()
    return (d**3).mean() / (d**2).mean() ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2)


def kurtosis(z):
    n, d = len(z), z - z.mean()
    g = (d**4).mean() / (d**2).mean() ** 2 - 3
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)


def ewm(alpha, least):
    def one(z):
        out, value, old, seen = [], NAN, 1.0, 0
        for q in z:
            if not np.isnan(q):
                value = q if np.isnan(value) else (old * (1 - alpha) * value + alpha * q) / (old * (1 - alpha) + alpha)
                old, seen = 1.0, seen + 1
            else:
                old *= 1 - alpha
            out.append(value if seen >= least else NAN)
        return out

    return lambda z: np.array([one(z[:, i]) for i in range(N)]).T


def corr(w):
    z = windows(w, lambda u, q: np.cov(u, q)[0, 1] / (u.std(ddof=1) * q.std(ddof=1) + EPS), "x", "y", early=0.0)
    z[: w - 1] = NAN
    return z


def bucket(side, q):
    def f(key, value):
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(key))
        rank[order] = np.arange(1, len(key) + 1) / len(key)
        return value[rank <= q + 1e-9].sum() if side == "low" else value[rank >= 1 - q - 1e-9].sum()

    return f


def sorted_spread(n):
    return lambda key, value: (value[np.argsort(key, kind="stable")[-n:]].sum() - value[np.argsort(key, kind="stable")[:n]].sum()) / n


def held(price, part):
    rest, weights = 1.0, []
    for q in part[::-1]:
        weights.append(rest * q)
        rest *= 1 - q
    return (np.array(weights) * price[::-1]).sum() / sum(weights)


def mean(z, w):
    return windows(w, np.mean, z)


true = np.where(np.isnan(A["x"]) | np.isnan(A["y"]), 0.0, (A["x"] > A["y"]).astype(float))
fade = lambda n, b: b ** np.arange(n)[::-1]
ema = ewm(2 / 11, 1)(A["x"])
CASES = {
    "add": (x + y, A["x"] + A["y"]), "sub": (x - y, A["x"] - A["y"]), "mul": (x * y, A["x"] * A["y"]), "div": (X.div(x, k), np.where(A["k"] == 0, NAN, A["x"] / np.where(A["k"] == 0, 1, A["k"]))), "neg": (-x, -A["x"]),
    "gt": (X.indicator(X.gt(x, y)), compare(np.greater)), "lt": (X.indicator(X.lt(x, y)), compare(np.less)), "ge": (X.indicator(X.ge(x, y)), compare(np.greater_equal)), "le": (X.indicator(X.le(x, y)), compare(np.less_equal)),
    "eq": (X.indicator(X.eq(x, y)), compare(np.equal)), "ne": (X.indicator(X.ne(x, y)), compare(np.not_equal, 1.0)),
    "and": (X.indicator(X.gt(x, y) & X.gt(k, 0)), true * (np.nan_to_num(A["k"]) > 0)), "or": (X.indicator(X.gt(x, y) | X.gt(k, 0)), np.maximum(true, np.nan_to_num(A["k"]) > 0)), "not": (X.indicator(~X.gt(x, y)), 1 - true),
    "where": (X.where(X.gt(x, y), k, 3.0), np.where(true == 1, A["k"], 3.0)), "abs": (X.abs_(x), np.abs(A["x"])), "sign": (X.sign(k), np.sign(A["k"])), "log": (X.log(x), np.log(np.maximum(A["x"], EPS))),
    "slog1p": (X.slog1p(x), np.sign(A["x"]) * np.log1p(np.abs(A["x"]))), "inv": (X.inv(k), np.where(np.abs(A["k"]) > EPS, 1 / np.where(A["k"] == 0, 1, A["k"]), NAN)), "sqrt": (X.sqrt(x), np.sqrt(np.maximum(A["x"], 0))),
    "power": (X.power(x, 2), A["x"] ** 2), "root": (X.power(x, 0.5), np.where(A["x"] < 0, NAN, np.sqrt(np.abs(A["x"])))), "greater": (X.greater(x, y), np.maximum(A["x"], A["y"])), "less": (X.less(x, y), np.minimum(A["x"], A["y"])),
    "shadow": (X.upper_shadow(o, h, c, X.delay(c, 1)), (A["high"] - np.maximum(A["open"], A["close"])) / shift(A["close"], 1)),
    "rank": (X.cs_rank(k), dates(least_rank, "k")), "zscore": (X.cs_zscore(x), dates(lambda z: (z - np.nanmean(z)) / np.nanstd(z, ddof=1), "x")), "cs_mean": (X.cs_mean(x), dates(lambda z: np.full(N, np.nanmean(z)), "x")),
    "cs_sum": (X.cs_sum(x), dates(lambda z: np.full(N, np.nansum(z)), "x")), "cs_std": (X.cs_std(x), dates(lambda z: np.full(N, np.nanstd(z)), "x")), "cs_std1": (X.cs_std(x, 1), dates(lambda z: np.full(N, np.nanstd(z, ddof=1)), "x")),
    "cs_skew": (X.cs_skew(x), dates(lambda z: np.full(N, np.nanmean((z - np.nanmean(z)) ** 3) / np.nanstd(z) ** 3), "x")), "cs_max": (X.cs_max(x), dates(lambda z: np.full(N, np.nanmax(z)), "x")), "cs_min": (X.cs_min(x), dates(lambda z: np.full(N, np.nanmin(z)), "x")),
    "scale": (X.scale(x, 2.0), 2 * A["x"] / np.nansum(np.abs(A["x"]), axis=0)), "scale_date": (X.scale(x, axis="cross"), A["x"] / np.nansum(np.abs(A["x"]), axis=1)[:, None]),
    "industry": (X.indneutralize(x, "industry"), dates(lambda z: z - np.array([np.nanmean(z[np.arange(N) % 3 == i % 3]) for i in range(N)]), "x")),
    "resid": (X.cs_reg_resid(x, y, 5), dates(residual, "x", "y")), "resid2": (X.cs_multi_reg_resid(x, y, k, min_obs=5), dates(residual, "x", "y", "k")),
    "ts_sum": (X.ts_sum(x, 5), windows(5, np.sum, "x")), "ts_mean": (X.ts_mean(x, 5), mean("x", 5)), "ts_std": (X.ts_std(x, 5), windows(5, lambda z: z.std(ddof=1), "x")), "ts_var": (X.ts_var(x, 5), windows(5, lambda z: z.var(ddof=1), "x")),
    "ts_ir": (X.ts_ir(x, 5), windows(5, lambda z: z.mean() / z.std(ddof=1), "x")), "ts_skew": (X.ts_skew(p, 7), windows(7, skewness, "p")), "ts_kurt": (X.ts_kurt(p, 7), windows(7, kurtosis, "p")), "ts_med": (X.ts_med(x, 4), windows(4, np.median, "x")),
    "ts_mad": (X.ts_mad(x, 5), windows(5, lambda z: np.abs(z - z.mean()).mean(), "x")), "ts_count": (X.ts_count(x, 5), np.where(np.arange(T)[:, None] < 4, NAN, windows(5, lambda z: (~np.isnan(z)).sum(), "x", gaps=True))), "count": (X.count_true(X.gt(x, y), 5), windows(5, np.sum, true)),
    "sumif": (X.sumif(k, 5, X.gt(x, y)), windows(5, np.sum, np.where(true == 1, A["k"], 0.0))), "product": (X.product(x, 4), windows(4, np.prod, "x")), "ts_max": (X.ts_max(x, 4), windows(4, np.max, "x")), "ts_min": (X.ts_min(x, 4), windows(4, np.min, "x")),
    "max_diff": (X.ts_max_diff(x, 4), A["x"] - windows(4, np.max, "x")), "min_diff": (X.ts_min_diff(x, 4), A["x"] - windows(4, np.min, "x")), "span": (X.ts_min_max_diff(x, 4), windows(4, np.ptp, "x")),
    "argmax": (X.ts_argmax(k, 6), windows(6, lambda z: 1 + z.argmax(), "k")), "argmin": (X.ts_argmin(k, 6), windows(6, lambda z: 1 + z.argmin(), "k")), "highday": (X.highday(k, 6), windows(6, lambda z: 6 - z.argmax(), "k")), "lowday": (X.lowday(k, 6), windows(6, lambda z: 6 - z.argmin(), "k")),
    "ts_rank": (X.ts_rank(k, 6), windows(6, lambda z: 1 + (z < z[-1]).sum(), "k")), "quantile": (X.ts_quantile(x, 5, 0.3), windows(5, lambda z: np.quantile(z, 0.3), "x")), "delay": (X.delay(x, 3), shift(A["x"], 3)), "ahead": (X.delay(x, -2), shift(A["x"], -2)), "delta": (X.delta(x, 2), A["x"] - shift(A["x"], 2)),
    "returns": (X.wide_returns(p), A["p"] / shift(A["p"], 1) - 1), "change": (X.ts_pct_change(k, 2), np.where(shift(A["k"], 2) == 0, NAN, A["k"] / np.where(shift(A["k"], 2) == 0, 1, shift(A["k"], 2)) - 1)),
    "decay": (X.decay_linear(x, 4), windows(4, lambda z: (z * [1, 2, 3, 4]).sum() / 10, "x")), "wma": (X.wma(x, 4), windows(4, lambda z: (z * fade(4, 0.9)).sum() / fade(4, 0.9).sum(), "x")), "weighted": (X.weighted_mean(x, 4, 2), windows(4, lambda z: (z * fade(4, 0.5**0.5)).sum() / 4, "x")), "even": (X.weighted_mean(x, 4), mean("x", 4)),
    "lagged": (X.ts_exp_weighted_mean_lagged(x, 4), windows(4, lambda z: NAN if np.isnan(z).all() else (np.nan_to_num(z) * fade(4, 0.6)[-len(z) :]).sum() / 4 if len(z) else NAN, "x", last=1, gaps=True)),
    "vwm": (X.volume_weighted_mean(x, v, 4), windows(4, lambda z, q: (z * q).sum() / q.sum(), "x", "v")), "ema": (X.ema(x, 10), ema), "macd": (X.macd(x, 3, 6), ewm(2 / 4, 3)(A["x"]) - ewm(2 / 7, 6)(A["x"])), "sma": (X.sma(x, 7, 2), ewm(2 / 7, 1)(A["x"])),
    "corr": (X.ts_corr(x, y, 5), corr(5)), "cov": (X.ts_cov(x, y, 5), windows(5, lambda z, q: np.cov(z, q)[0, 1], "x", "y")), "slope": (X.slope(x, 5), windows(5, lambda z: fit(z)[0], "x")), "beta": (X.regbeta(x, 5), windows(5, lambda z: fit(z)[0], "x")),
    "rsquare": (X.rsquare(x, 5), windows(5, lambda z: 1 - ((z - fit(z)[1] - fit(z)[0] * np.arange(5)) ** 2).sum() / (((z - z.mean()) ** 2).sum() + EPS), "x")), "resi": (X.resi(x, 5), windows(5, lambda z: z[-1] - fit(z)[1] - fit(z)[0] * 4, "x")),
    "reg_slope": (X.regression_slope(x, y, 5), windows(5, lambda z, q: np.cov(z, q)[0, 1] / (q.var(ddof=1) + EPS), "x", "y")), "reg_rsq": (X.regression_rsq(x, y, 5), windows(5, lambda z, q: np.cov(z, q)[0, 1] ** 2 / (z.var(ddof=1) * q.var(ddof=1) + EPS), "x", "y")),
    "reg_resid": (X.regression_residual(x, y, 5), windows(5, lambda z, q: z[-1] - z.mean() - np.cov(z, q)[0, 1] / (q.var(ddof=1) + EPS) * (q[-1] - q.mean()), "x", "y")),
    "low_bucket": (X.bucket_sum(x, k, 10, 0.3, "low"), windows(10, bucket("low", 0.3), "k", "x")), "high_bucket": (X.bucket_sum(x, k, 10, 0.3, "high"), windows(10, bucket("high", 0.3), "k", "x")), "sorted": (X.ts_sorted_mean_spread(x, k, 8, 0.25), windows(8, sorted_spread(2), "k", "x")),
    "held": (X.ts_turnover_ref_price(p, t, 6), windows(6, held, "p", "t")), "relative": (X.relative(v, 5), A["v"] / mean("v", 5)), "adv": (X.adv(v, 5), mean("v", 5)), "cntp": (X.cntp_mean(X.gt(x, y), 5), windows(5, np.mean, true)),
}

r158, r101, r191, r360 = bars158.factors(), formulaic101.factors(), methods191.factors(), lags360.factors()
O, H, L, C, V, W = (A[n] for n in ("open", "high", "low", "close", "volume", "vwap"))
up, ret = C > shift(C, 1), C / shift(C, 1) - 1
known = ~np.isnan(shift(C, 1))
CATALOG = {
    "alpha158.KMID": (r158["KMID"], (C - O) / O), "alpha158.KUP2": (r158["KUP2"], (H - np.maximum(O, C)) / (H - L + EPS)), "alpha158.KSFT": (r158["KSFT"], (2 * C - H - L) / O), "alpha158.ROC5": (r158["ROC5"], shift(C, 5) / C), "alpha158.MA10": (r158["MA10"], mean("close", 10) / C), "alpha158.STD5": (r158["STD5"], windows(5, lambda z: z.std(ddof=1), "close") / C), "alpha158.MIN10": (r158["MIN10"], windows(10, np.min, "low") / C), "alpha158.VMA5": (r158["VMA5"], mean("volume", 5) / (V + EPS)),
    "alpha101.012": (r101["alpha012"], np.sign(V - shift(V, 1)) * -(C - shift(C, 1))), "alpha101.041": (r101["alpha041"], np.sqrt(H * L) - W), "alpha101.042": (r101["alpha042"], dates(least_rank, W - C) / dates(least_rank, W + C)), "alpha101.101": (r101["alpha101"], (C - O) / (H - L + 0.001)), "alpha101.053": (r101["alpha053"], -(((C - L) - (H - C)) / (C - L) - shift(((C - L) - (H - C)) / (C - L), 9))), "alpha101.033": (r101["alpha033"], dates(least_rank, -(1 - O / C))),
    "alpha191.014": (r191["alpha014"], C - shift(C, 5)), "alpha191.018": (r191["alpha018"], C / shift(C, 5)), "alpha191.020": (r191["alpha020"], (C - shift(C, 6)) / shift(C, 6) * 100), "alpha191.034": (r191["alpha034"], mean("close", 12) / C), "alpha191.053": (r191["alpha053"], windows(12, np.sum, up.astype(float)) / 12 * 100), "alpha191.058": (r191["alpha058"], windows(20, np.sum, up.astype(float)) / 20 * 100), "alpha191.106": (r191["alpha106"], C - shift(C, 20)), "alpha191.070": (r191["alpha070"], windows(6, lambda z: z.std(ddof=1), "amount")),
    "alpha360.CLOSE1": (r360["CLOSE1"], shift(C, 1) / C), "alpha360.VOLUME3": (r360["VOLUME3"], shift(V, 3) / (V + EPS)), "alpha360.HIGH0": (r360["HIGH0"], H / C), "alpha360.LOW20": (r360["LOW20"], shift(L, 20) / C),
}


@pytest.fixture(scope="module")
def panel(spark):
    days = [datetime.date(2021, 3, 1) + datetime.timedelta(n) for n in range(T)]
    rows = [(days[d], i, f"g{i % 3}", *[None if np.isnan(z[d, i]) else float(z[d, i]) for z in FIELDS.values()]) for d in range(T) for i in range(N)]
    return stored(spark.createDataFrame(rows, "dt date, instrument int, industry string, " + ", ".join(f"{n} double" for n in FIELDS)), "restated")


def check(panel, cases, names):
    plain = {f"c{j}": cases[n][0] for j, n in enumerate(names)}
    got = compute(panel, plain).toPandas().sort_values(["dt", "instrument"])
    for j, n in enumerate(names):
        mine, expected = got[f"c{j}"].to_numpy(float).reshape(T, N), np.asarray(cases[n][1], float)
        assert (np.isnan(mine) == np.isnan(expected)).all(), (n, np.argwhere(np.isnan(mine) != np.isnan(expected))[:3])
        assert np.allclose(mine, expected, rtol=1e-8, atol=1e-9, equal_nan=True), (n, np.nanmax(np.abs(mine - expected)))
        assert (~np.isnan(expected)).sum() > 50, n


@pytest.mark.parametrize("part", range(4))
def test_operators(panel, part):
    check(panel, CASES, list(CASES)[part::4])


def test_formulas(panel):
    check(panel, CATALOG, list(CATALOG))
