"""158 price and volume factors: bar shapes, and 29 families over windows of 5 to 60 rows.

MAX is the window's highest high over the close, as its manifest has it.
"""

from __future__ import annotations

from quantloom.functions.expr import Expr, abs_, cntp_mean, delay, delta, div, field, greater, gt, less, log, lt, resi, rsquare, slope, ts_argmax, ts_argmin, ts_corr, ts_max, ts_mean, ts_min, ts_quantile, ts_rank, ts_std, ts_sum

o, h, l, c, v, w = (field(n) for n in ("open", "high", "low", "close", "volume", "vwap"))  # noqa: E741
WINDOWS = (5, 10, 20, 30, 60)
E = 1e-12


def _share(x: Expr, n: int, up: bool) -> Expr:
    """Sum of the rises (or falls) over the sum of all moves."""
    d = delta(x, 1)
    part = greater(d, 0) if up else greater(-d, 0)
    return div(ts_sum(part, n), ts_sum(abs_(d), n) + E)


def bars() -> dict[str, Expr]:
    top, bottom, span = greater(o, c), less(o, c), h - l + E
    out = {
        "KMID": div(c - o, o),
        "KLEN": div(h - l, o),
        "KMID2": div(c - o, span),
        "KUP": div(h - top, o),
        "KUP2": div(h - top, span),
        "KLOW": div(bottom - l, o),
        "KLOW2": div(bottom - l, span),
        "KSFT": div(2 * c - h - l, o),
        "KSFT2": div(2 * c - h - l, span),
    }
    return out | {f"{n}0": div(x, c) for n, x in (("OPEN", o), ("HIGH", h), ("LOW", l), ("VWAP", w))}


def family(n: int) -> dict[str, Expr]:
    before = delay(c)
    move = abs_(div(c, before) - 1) * v
    made = {
        "ROC": div(delay(c, n), c),
        "MA": div(ts_mean(c, n), c),
        "STD": div(ts_std(c, n), c),
        "BETA": div(slope(c, n), c),
        "RSQR": rsquare(c, n),
        "RESI": div(resi(c, n), c),
        "MAX": div(ts_max(h, n), c),
        "MIN": div(ts_min(l, n), c),
        "QTLU": div(ts_quantile(c, n, 0.8), c),
        "QTLD": div(ts_quantile(c, n, 0.2), c),
        "RANK": ts_rank(c, n),
        "RSV": div(c - ts_min(l, n), ts_max(h, n) - ts_min(l, n) + E),
        "IMAX": ts_argmax(h, n) / n,
        "IMIN": ts_argmin(l, n) / n,
        "IMXD": (ts_argmax(h, n) - ts_argmin(l, n)) / n,
        "CORR": ts_corr(c, log(v + 1), n),
        "CORD": ts_corr(div(c, before), log(div(v, delay(v)) + 1), n),
        "CNTP": cntp_mean(gt(c, before), n),
        "CNTN": cntp_mean(lt(c, before), n),
        "CNTD": cntp_mean(gt(c, before), n) - cntp_mean(lt(c, before), n),
        "SUMP": _share(c, n, True),
        "SUMN": _share(c, n, False),
        "SUMD": _share(c, n, True) - _share(c, n, False),
        "VMA": div(ts_mean(v, n), v + E),
        "VSTD": div(ts_std(v, n), v + E),
        "WVMA": div(ts_std(move, n), ts_mean(move, n) + E),
        "VSUMP": _share(v, n, True),
        "VSUMN": _share(v, n, False),
        "VSUMD": _share(v, n, True) - _share(v, n, False),
    }
    return {f"{k}{n}": x for k, x in made.items()}


def factors() -> dict[str, Expr]:
    out = bars()
    for n in WINDOWS:
        out |= family(n)
    return out
