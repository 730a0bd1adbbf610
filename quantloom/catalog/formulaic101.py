"""The 101 published formulaic factors, windows rounded to whole rows.

Where practice differs from the published text, the form in use is built: correlations that are missing
count as 0 in most formulas, `scale` runs over an instrument's whole history (it looks ahead), some
comparisons are rescaled so that both sides are on one level, and a few divisors of 0 become 0.0001.
"""

from __future__ import annotations

from quantloom.functions.expr import Expr, abs_, cs_rank, decay_linear, delay, delta, div, elem, eq, field, fill, greater, gt, indicator, indneutralize, le, less, log, lt, neg, power, product, scale, sign, ts_argmax, ts_argmin, ts_corr, ts_cov, ts_max, ts_mean, ts_min, ts_rank, ts_std, ts_sum, where

o, h, l, c, v, w = (field(n) for n in ("open", "high", "low", "close", "volume", "vwap"))  # noqa: E741
r = div(c, delay(c)) - 1
cap = elem("nullif({0}, 0)", field("amount"))
mid = (h + l) / 2
R, D = cs_rank, decay_linear


def adv(n: int) -> Expr:
    return ts_mean(v, n)


def corr0(x, y, n: int) -> Expr:
    return fill(ts_corr(x, y, n), 0)


def mix(a: Expr, b: Expr, share: float) -> Expr:
    return a * share + b * (1 - share)


def or_if_zero(x: Expr, other: float) -> Expr:
    return where(eq(x, 0), other, x)


def _spread() -> Expr:
    return (delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10


def _place(floor: float | None = None) -> Expr:
    return div((c - l) - (h - c), or_if_zero(h - l, floor) if floor else h - l)


def _flow() -> Expr:
    return ts_sum(o, 5) * ts_sum(r, 5)


def _move(n: int) -> Expr:
    d = delta(c, 1)
    return where(gt(ts_min(d, n), 0) | lt(ts_max(d, n), 0), d, -d)


def _alpha021() -> Expr:
    a = lt(ts_mean(c, 8) + ts_std(c, 8), ts_mean(c, 2))
    b = lt(ts_mean(c, 2), ts_mean(c, 8) - ts_std(c, 8))
    low = lt(div(adv(20), v), 1)
    return where(a | (~a & ~b & ~low), -1, 1)


def _alpha048() -> Expr:
    d = delta(c, 1)
    top = indneutralize(div(corr0(d, delta(delay(c), 1), 250) * d, c), "subindustry")
    return div(top, ts_sum(power(div(d, delay(c)), 2), 250))


def _alpha100() -> Expr:
    neutral = lambda x: indneutralize(x, "subindustry")
    left = 1.5 * scale(neutral(neutral(R(_place() * v))))
    right = scale(neutral(corr0(c, R(adv(20)), 5) - R(ts_argmin(c, 30))))
    return -((left - right) * div(v, adv(20)))


FACTORS: dict[int, Expr] = {
    1: R(ts_argmax(power(where(lt(r, 0), ts_std(r, 20), c), 2), 5)) - 0.5,
    2: -corr0(R(delta(log(v), 2)), R(div(c - o, o)), 6),
    3: -corr0(R(o), R(v), 10),
    4: -ts_rank(R(l), 9),
    5: R(o - ts_sum(w, 10) / 10) * -abs_(R(c - w)),
    6: -corr0(o, v, 10),
    7: where(adv(20) >= v, -1, -ts_rank(abs_(delta(c, 7)), 60) * sign(delta(c, 7))),
    8: -R(_flow() - delay(_flow(), 10)),
    9: _move(5),
    10: R(_move(4)),
    11: (R(ts_max(w - c, 3)) + R(ts_min(w - c, 3))) * R(delta(v, 3)),
    12: sign(delta(v, 1)) * -delta(c, 1),
    13: -R(ts_cov(R(c), R(v), 5)),
    14: -R(delta(r, 3)) * corr0(o, v, 10),
    15: -ts_sum(R(corr0(R(h), R(v), 3)), 3),
    16: -R(ts_cov(R(h), R(v), 5)),
    17: -(R(ts_rank(c, 10)) * R(delta(delta(c, 1), 1)) * R(ts_rank(div(v, adv(20)), 5))),
    18: -R(ts_std(abs_(c - o), 5) + (c - o) + corr0(c, o, 10)),
    19: -sign((c - delay(c, 7)) + delta(c, 7)) * (1 + R(1 + ts_sum(r, 250))),
    20: -(R(o - delay(h)) * R(o - delay(c)) * R(o - delay(l))),
    21: _alpha021(),
    22: -delta(corr0(h, v, 5), 5) * R(ts_std(c, 20)),
    23: where(lt(ts_mean(h, 20), h), -fill(delta(h, 2), 0), 0),
    24: where(le(div(delta(ts_mean(c, 100), 100), delay(c, 100)), 0.05), -(c - ts_min(c, 100)), -delta(c, 3)),
    25: R(-r * adv(20) * w * (h - c)),
    26: -ts_max(corr0(ts_rank(v, 5), ts_rank(h, 5), 5), 3),
    27: sign((R(ts_mean(ts_corr(R(v), R(w), 6), 2) / 2) - 0.5) * -2),
    28: scale(corr0(adv(20), l, 5) + mid - c),
    29: ts_min(R(R(scale(log(ts_sum(R(R(-R(delta(c - 1, 5)))), 2))))), 5) + ts_rank(delay(-r, 6), 5),
    30: div((1 - R(sign(delta(c, 1)) + sign(delay(delta(c, 1))) + sign(delay(delta(c, 1), 2)))) * ts_sum(v, 5), ts_sum(v, 20)),
    31: R(R(R(D(-R(R(delta(c, 10))), 10)))) + R(-delta(c, 3)) + sign(scale(corr0(adv(20), l, 12))),
    32: scale(ts_mean(c, 7) / 7 - c) + 20 * scale(ts_corr(w, delay(c, 5), 230)),
    33: R(div(o, c) - 1),
    34: R(2 - R(fill(div(ts_std(r, 2), ts_std(r, 5)), 1)) - R(delta(c, 1))),
    35: ts_rank(v, 32) * (1 - ts_rank(c + h - l, 16)) * (1 - ts_rank(r, 32)),
    36: 2.21 * R(ts_corr(c - o, delay(v), 15)) + 0.7 * R(o - c) + 0.73 * R(ts_rank(delay(-r, 6), 5)) + R(abs_(ts_corr(w, adv(20), 6))) + 0.6 * R((ts_mean(c, 200) - o) * (c - o)),
    37: R(ts_corr(delay(o - c), c, 200)) + R(o - c),
    38: -R(ts_rank(o, 10)) * R(fill(div(c, o), 1)),
    39: -R(delta(c, 7) * (1 - R(D(div(v, adv(20)), 9)))) * (1 + R(ts_mean(r, 250))),
    40: -R(ts_std(h, 10)) * ts_corr(h, v, 10),
    41: power(h * l, 0.5) - w,
    42: div(R(w - c), R(w + c)),
    43: ts_rank(div(v, adv(20)), 20) * ts_rank(-delta(c, 7), 8),
    44: -corr0(h, R(v), 5),
    45: -(R(ts_mean(delay(c, 5), 20)) * corr0(c, v, 2) * R(ts_corr(ts_sum(c, 5), ts_sum(c, 20), 2))),
    46: where(gt(_spread(), 0.25), -1, where(lt(_spread(), 0), 1, -delta(c, 1))),
    47: div(R(div(1, c)) * v, adv(20)) * div(h * R(h - c), ts_mean(h, 5) / 5) - R(w - delay(w, 5)),
    48: _alpha048(),
    49: where(lt(_spread(), -0.1), 1, -delta(c, 1)),
    50: -ts_max(R(ts_corr(R(v), R(w), 5)), 5),
    51: where(lt(_spread(), -0.05), 1, -delta(c, 1)),
    52: -delta(ts_min(l, 5), 5) * R((ts_sum(r, 240) - ts_sum(r, 20)) / 220) * ts_rank(v, 5),
    53: -delta(div((c - l) - (h - c), or_if_zero(c - l, 0.0001)), 9),
    54: div(-(l - c) * power(o, 5), or_if_zero(l - h, -0.0001) * power(c, 5)),
    55: -corr0(R(div(c - ts_min(l, 12), or_if_zero(ts_max(h, 12) - ts_min(l, 12), 0.0001))), R(v), 6),
    56: -(R(div(ts_sum(r, 10), ts_sum(ts_sum(r, 2), 3))) * R(r * cap)),
    57: -div(c - w, D(R(ts_argmax(c, 30)), 2)),
    58: -ts_rank(D(corr0(indneutralize(w, "sector"), v, 4), 8), 6),
    59: -ts_rank(D(corr0(indneutralize(w, "industry"), v, 4), 16), 8),
    60: -(2 * scale(R(div(((c - l) - (h - c)) * v, or_if_zero(h - l, 0.0001)))) - scale(R(ts_argmax(c, 10)))),
    61: indicator(lt(R(w - ts_min(w, 16)), R(ts_corr(w, adv(180), 18)))),
    62: neg(lt(R(ts_corr(w, ts_mean(adv(20), 22), 10)), R(indicator(lt(R(o) + R(o), R(mid) + R(h)))))),
    63: -(R(D(delta(indneutralize(c, "industry"), 2), 8)) - R(D(corr0(mix(w, o, 0.318108), ts_sum(adv(180), 37), 14), 12))),
    64: neg(lt(R(ts_corr(ts_mean(mix(o, l, 0.178404), 13), ts_mean(adv(120), 13), 17)), R(delta(mix(mid, w, 0.178404), 4)))),
    65: neg(lt(R(ts_corr(mix(o, w, 0.00817205), ts_mean(adv(60), 9), 6)), R(o - ts_min(o, 14)))),
    66: -(R(D(delta(w, 4), 7)) + ts_rank(D(div(mix(l, l, 0.96633) - w, o - mid), 11), 7)),
    67: -power(R(h - ts_min(h, 2)), R(corr0(indneutralize(w, "sector"), indneutralize(adv(20), "subindustry"), 6))),
    68: neg(lt(ts_rank(ts_corr(R(h), R(adv(15)), 9), 14), R(delta(mix(c, l, 0.518371), 2)) * 14)),
    69: -power(R(ts_max(delta(indneutralize(w, "industry"), 3), 5)), ts_rank(corr0(mix(c, w, 0.490655), adv(20), 5), 9)),
    70: -power(R(delta(w, 1)), ts_rank(corr0(indneutralize(c, "industry"), adv(50), 18), 18)),
    71: greater(ts_rank(D(ts_corr(ts_rank(c, 3), ts_rank(adv(180), 12), 18), 4), 16), ts_rank(D(power(R(l + o - (w + w)), 2), 16), 4)),
    72: div(R(D(ts_corr(mid, adv(40), 9), 10)), R(D(ts_corr(ts_rank(w, 4), ts_rank(v, 19), 7), 3))),
    73: -greater(R(D(delta(w, 5), 3)), ts_rank(D(-div(delta(mix(o, l, 0.147155), 2), mix(o, l, 0.147155)), 3), 17)),
    74: neg(lt(R(ts_corr(c, ts_mean(adv(30), 37), 15)), R(ts_corr(R(mix(h, w, 0.0261661)), R(v), 11)))),
    75: indicator(lt(R(ts_corr(w, v, 4)), R(ts_corr(R(l), R(adv(50)), 12)))),
    76: -greater(R(D(delta(w, 1), 12)), ts_rank(D(ts_rank(corr0(indneutralize(l, "sector"), adv(81), 8), 20), 17), 19)),
    77: less(R(D(mid + h - (w + h), 20)), R(D(ts_corr(mid, adv(40), 3), 6))),
    78: power(R(ts_corr(ts_sum(mix(l, w, 0.352233), 20), ts_sum(adv(40), 20), 7)), R(ts_corr(R(w), R(v), 6))),
    79: indicator(lt(R(delta(indneutralize(mix(c, o, 0.60733), "sector"), 1)), R(corr0(ts_rank(w, 4), ts_rank(adv(150), 9), 15)))),
    80: -power(R(sign(delta(indneutralize(mix(o, h, 0.868128), "industry"), 4))), ts_rank(corr0(h, adv(10), 5), 6)),
    81: neg(lt(R(log(product(R(power(R(ts_corr(w, ts_sum(adv(10), 50), 8)), 4)), 15))), R(ts_corr(R(w), R(v), 5)))),
    82: -less(R(D(delta(o, 1), 15)), ts_rank(D(corr0(indneutralize(v, "sector"), o, 17), 7), 13)),
    83: div(R(delay(div(h - l, ts_sum(c, 5) / 5), 2)) * R(R(v)), div(div(h - l, ts_sum(c, 5) / 5), w - c)),
    84: power(ts_rank(w - ts_max(w, 15), 21), delta(c, 5)),
    85: power(R(ts_corr(mix(h, c, 0.876703), adv(30), 10)), R(ts_corr(ts_rank(mid, 4), ts_rank(v, 10), 7))),
    86: neg(lt(ts_rank(ts_corr(c, ts_mean(adv(20), 15), 6), 20), R((o + c) - (w + o)) * 20)),
    87: -greater(R(D(delta(mix(c, w, 0.369701), 2), 3)), ts_rank(D(abs_(corr0(indneutralize(adv(81), "industry"), c, 13)), 5), 14)),
    88: less(R(D((R(o) + R(l)) - (R(h) + R(c)), 8)), ts_rank(D(ts_corr(ts_rank(c, 8), ts_rank(adv(60), 21), 8), 7), 3)),
    89: ts_rank(D(corr0(l, adv(10), 7), 6), 4) - ts_rank(D(delta(indneutralize(w, "industry"), 3), 10), 15),
    90: -power(R(c - ts_max(c, 5)), ts_rank(corr0(indneutralize(adv(40), "subindustry"), l, 5), 3)),
    91: -(ts_rank(D(D(corr0(indneutralize(c, "industry"), v, 10), 16), 4), 5) - R(D(corr0(w, adv(30), 4), 3))),
    92: less(ts_rank(D(indicator(lt(mid + c, l + o)), 15), 19), ts_rank(D(ts_corr(R(l), R(adv(30)), 8), 7), 7)),
    93: div(ts_rank(D(corr0(indneutralize(w, "industry"), adv(81), 17), 20), 8), R(D(delta(mix(c, w, 0.524434), 3), 16))),
    94: -power(R(w - ts_min(w, 12)), ts_rank(ts_corr(ts_rank(w, 20), ts_rank(adv(60), 4), 18), 3)),
    95: indicator(lt(R(o - ts_min(o, 12)) * 12, ts_rank(power(R(ts_corr(ts_mean(mid, 19), ts_mean(adv(40), 19), 13)), 5), 12))),
    96: -greater(ts_rank(D(ts_corr(R(w), R(v), 4), 4), 8), ts_rank(D(ts_argmax(ts_corr(ts_rank(c, 7), ts_rank(adv(60), 4), 4), 13), 14), 13)),
    97: -(R(D(delta(indneutralize(mix(l, w, 0.721001), "industry"), 3), 20)) - ts_rank(D(ts_rank(corr0(ts_rank(l, 8), ts_rank(adv(60), 17), 5), 19), 16), 7)),
    98: R(D(ts_corr(w, ts_mean(adv(5), 26), 5), 7)) - R(D(ts_rank(ts_argmin(ts_corr(R(o), R(adv(15)), 21), 9), 7), 8)),
    99: neg(lt(R(ts_corr(ts_sum(mid, 20), ts_sum(adv(60), 20), 9)), R(ts_corr(l, v, 6)))),
    100: _alpha100(),
    101: div(c - o, (h - l) + 0.001),
}


def factors() -> dict[str, Expr]:
    return {f"alpha{n:03d}": x for n, x in FACTORS.items()}
