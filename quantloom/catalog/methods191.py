"""191 published price and volume methods; four of them (030, 143, 149, 190) have no usable definition and are all missing.

Where the published text is unclear, the form in use is built: 004 compares one band; 059 uses the low on
both sides; 084 counts nothing on falls and minus the volume on no change; 054 uses the deviation of the
whole history (it looks ahead); 127 and 181 take 12 and 20 rows; 162 smooths in place of a maximum; 165
and 183 use the date's extremes of the rolling sum.
"""

from __future__ import annotations

from quantloom.functions.expr import Expr, abs_, count_true, cs_max, cs_min, cs_rank, decay_linear, delay, delta, div, elem, eq, field, ge, greater, gt, highday, indicator, le, less, lit, log, lowday, lt, neg, power, product, regbeta, sign, sma, sumif, ts, ts_corr, ts_cov, ts_max, ts_mean, ts_min, ts_rank, ts_std, ts_sum, where, wma

o, h, l, c, v, w, amount = (field(n) for n in ("open", "high", "low", "close", "volume", "vwap", "amount"))  # noqa: E741
bo, bc = field("benchmark_open"), field("benchmark_close")
p1 = delay(c)
r = div(c, p1) - 1
d1 = c - p1
mid, typical = (h + l) / 2, (h + l + c) / 3
R, D, corr, mean, total, std, S = cs_rank, decay_linear, ts_corr, ts_mean, ts_sum, ts_std, sma
up, down, same = gt(c, p1), lt(c, p1), eq(c, p1)
MISSING = elem("CAST(NULL AS DOUBLE)")


def pct(x: Expr, n: int) -> Expr:
    return div(x - delay(x, n), delay(x, n)) * 100


def over(x: Expr, n: int) -> Expr:
    return div(x - mean(x, n), mean(x, n)) * 100


def either(*cases: tuple[Expr, Expr | float]) -> Expr:
    """The value of the last case that holds; missing if none does."""
    out = MISSING
    for cond, value in cases:
        out = where(cond, value, out)
    return out


def place(n: int) -> Expr:
    return div(c - ts_min(l, n), ts_max(h, n) - ts_min(l, n)) * 100


def fall(n: int) -> Expr:
    return div(ts_max(h, n) - c, ts_max(h, n) - ts_min(l, n)) * 100


def strength(x: Expr, n: int, m: int = 1) -> Expr:
    return div(S(greater(delta(x, 1), 0), n, m), S(abs_(delta(x, 1)), n, m)) * 100


def balance() -> Expr:
    return div((c - l) - (h - c), h - l)


def range_sum(n: int, second: Expr) -> Expr:
    return total(either((same, 0), (up, c - less(l, p1)), (down, c - greater(second, p1))), n)


def signed_volume(n: int) -> Expr:
    return total(either((up, v), (down, -v), (same, 0)), n)


def travel() -> Expr:
    return greater(abs_(delta(h, 1)), abs_(delta(l, 1)))


def rise_cond(strict: bool) -> Expr:
    a, b = h + l, delay(h) + delay(l)
    return ge(a, b) if strict else le(a, b)


def split_moves(cond: Expr) -> tuple[Expr, Expr]:
    """Moves where the condition fails, and where it holds."""
    return total(where(cond, 0, travel()), 12), total(where(~cond, 0, travel()), 12)


def true_range_parts() -> tuple[Expr, Expr]:
    tr = greater(greater(h - l, abs_(h - p1)), abs_(l - p1))
    hd, ld = delta(h, 1), -delta(l, 1)
    a = total(where(gt(ld, 0) & gt(ld, hd), ld, 0), 14) * 100
    b = total(where(gt(hd, 0) & gt(hd, ld), hd, 0), 14) * 100
    return div(a, total(tr, 14)), div(b, total(tr, 14))


def directional() -> Expr:
    a, b = true_range_parts()
    return mean(div(abs_(a - b), a + b) * 100, 6)


def swing_base() -> Expr:
    a, b, e = abs_(h - p1), abs_(l - p1), abs_(h - delay(l))
    body = abs_(p1 - delay(o)) / 4
    return where(ge(e, a) & ge(e, b), e + body, where(gt(b, e) & gt(b, a), b + a / 2 + body, where(gt(a, b) & gt(a, e), a + b / 2 + body, 0)))


def swing() -> Expr:
    return div(16 * (c + (c - o) / 2 - delay(o)), swing_base()) * greater(abs_(h - p1), abs_(l - p1))


def spread(n: int) -> Expr:
    s = total(c - mean(c, n), n)
    return cs_max(s) - div(cs_min(s), std(c, n))


def demand() -> Expr:
    up_ = total(where(le(o, delay(o)), 0, greater(h - o, o - delay(o))), 20)
    low_ = total(where(ge(o, delay(o)), 0, greater(o - l, o - delay(o))), 20)
    return either((gt(up_, low_), div(up_ - low_, up_)), (eq(up_, low_), 0), (lt(up_, low_), div(up_ - low_, low_)))


def triple(x: Expr, n: int, m: int) -> Expr:
    return S(S(S(x, n, m), n, m), n, m)


def slow_gap(x: Expr) -> Expr:
    return (delay(x, 20) - delay(x, 10)) / 10 - (delay(x, 10) - x) / 10


def oscillator(n: int) -> Expr:
    low_, high_ = less(l, p1), greater(h, p1)
    return div(c - total(low_, n), total(high_ - low_, n))


def smoothed_return() -> tuple[Expr, Expr]:
    x = r
    return x, S(x, 61, 2)


def _alpha146() -> Expr:
    x, s = smoothed_return()
    return div(mean(x - s, 20) * (x - s), S(power(x - (x - s), 2), 61, 2))


def _alpha152() -> Expr:
    x = delay(S(delay(div(c, delay(c, 9))), 9, 1))
    return S(mean(x, 12) - mean(x, 26), 9, 1)


def _alpha162() -> Expr:
    x = strength(c, 12)
    return div(x - ts_min(x, 12), S(x, 12, 1) - ts_min(x, 12))


def _alpha164() -> Expr:
    x = where(up, div(1, d1), 1)
    return S(div(x - ts_min(x, 12), h - l) * 100, 13, 2)


def _alpha169() -> Expr:
    x = delay(S(d1, 9, 1))
    return S(mean(x, 12) - mean(x, 26), 10, 1)


def _alpha181() -> Expr:
    top = total((r - mean(r, 20)) - power(bc - mean(bc, 20), 2), 20)
    return div(top, total(power(bc - mean(bc, 20), 3), 20))


def _alpha004() -> Expr:
    a, b = mean(c, 8) + std(c, 8), mean(c, 2)
    return either((lt(a, b), -1), (gt(a, b), 1), (eq(a, b), -1), (eq(a, b) & ge(div(v, mean(v, 20)), 1), 1))


def _alpha010() -> Expr:
    return R(ts_max(power(where(lt(r, 0), std(r, 20), c), 2), 5))


def _alpha028() -> Expr:
    second = div(c - ts_min(l, 9), ts_max(h, 9) - ts_max(l, 9)) * 100
    return 3 * S(place(9), 3, 1) - 2 * S(S(second, 3, 1), 3, 1)


def _alpha054() -> Expr:
    whole = ts("stddev_samp({0}) OVER (PARTITION BY instrument)", abs_(c - o))
    return -R(whole + (c - o) + corr(c, o, 10))


def _alpha128() -> Expr:
    rising = gt(typical, delay(typical))
    a, b = total(where(rising, typical * v, 0), 14), total(where(rising, 0, typical * v), 14)
    return 100 - div(100, 1 + div(a, b))


def _alpha112() -> Expr:
    a, b = total(where(gt(d1, 0), d1, 0), 12), total(where(lt(d1, 0), abs_(d1), 0), 12)
    return div(a - b, a + b) * 100


def _volume_gap(a: int, b: int) -> Expr:
    return S(v, a, 2) - S(v, b, 2)


def _ratio_std() -> Expr:
    return div(abs_(r), v)


def _down_market() -> Expr:
    return lt(bc, bo)


def _std_if(cond: Expr) -> Expr:
    return where(cond, std(c, 20), 0)


FACTORS: dict[int, Expr] = {
    1: -corr(R(delta(log(v), 1)), R(div(c - o, o)), 6),
    2: -delta(balance(), 1),
    3: range_sum(6, h),
    4: _alpha004(),
    5: -ts_max(corr(ts_rank(v, 5), ts_rank(h, 5), 5), 3),
    6: -R(sign(delta(o * 0.85 + h * 0.15, 4))),
    7: (R(ts_max(w - c, 3)) + R(ts_min(w - c, 3))) * R(delta(v, 3)),
    8: R(-delta(mid * 0.2 + w * 0.8, 4)),
    9: S(div((mid - (delay(h) + delay(l)) / 2) * (h - l), v), 7, 2),
    10: _alpha010(),
    11: total(balance() * v, 6),
    12: R(o - total(w, 10) / 10) * -R(abs_(c - w)),
    13: power(h * l, 0.5) - w,
    14: delta(c, 5),
    15: div(o, p1) - 1,
    16: -ts_max(R(corr(R(v), R(w), 5)), 5),
    17: power(R(w - ts_max(w, 15)), delta(c, 5)),
    18: div(c, delay(c, 5)),
    19: either((lt(c, delay(c, 5)), div(delta(c, 5), delay(c, 5))), (eq(c, delay(c, 5)), 0), (gt(c, delay(c, 5)), div(delta(c, 5), c))),
    20: pct(c, 6),
    21: regbeta(mean(c, 6), 6),
    22: S(over(c, 6) / 100 - delay(over(c, 6) / 100, 3), 12, 1),
    23: div(S(_std_if(up), 20, 1), S(_std_if(up), 20, 1) + S(_std_if(~up), 20, 1)) * 100,
    24: S(delta(c, 5), 5, 1),
    25: -R(delta(c, 7) * (1 - R(D(div(v, mean(v, 20)), 9)))) * (1 + R(total(r, 250))),
    26: total(c, 7) / 7 - c + corr(w, delay(c, 5), 230),
    27: wma(pct(c, 3) + pct(c, 6), 12),
    28: _alpha028(),
    29: pct(c, 6) / 100 * v,
    30: MISSING,
    31: over(c, 12),
    32: -total(R(corr(R(h), R(v), 3)), 3),
    33: (delay(ts_min(l, 5), 5) - ts_min(l, 5)) * R((total(r, 240) - total(r, 20)) / 220) * ts_rank(v, 5),
    34: div(mean(c, 12), c),
    35: -less(R(D(delta(o, 1), 15)), R(D(corr(v, o * 0.65 + o * 0.35, 17), 7))),
    36: R(total(corr(R(v), R(w), 6), 2)),
    37: -R(total(o, 5) * total(r, 5) - delay(total(o, 5) * total(r, 5), 10)),
    38: where(lt(total(h, 20) / 20, h), -delta(h, 2), 0),
    39: -(R(D(delta(c, 2), 8)) - R(D(corr(w * 0.3 + o * 0.7, total(mean(v, 180), 37), 14), 12))),
    40: div(total(where(up, v, 0), 26), total(where(up, 0, v), 26)) * 100,
    41: -R(ts_max(delta(w, 3), 5)),
    42: -R(std(h, 10)) * corr(h, v, 10),
    43: signed_volume(6),
    44: ts_rank(D(corr(l, mean(v, 10), 7), 6), 4) + ts_rank(D(delta(w, 3), 10), 15),
    45: R(delta(c * 0.6 + o * 0.4, 1)) * R(corr(w, mean(v, 150), 15)),
    46: div(mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24), 4 * c),
    47: S(fall(6), 9, 1),
    48: -div(R(sign(d1) + sign(delay(d1)) + sign(delay(d1, 2))) * total(v, 5), total(v, 20)),
    49: div(split_moves(rise_cond(True))[0], split_moves(rise_cond(True))[0] + split_moves(rise_cond(False))[0]),
    50: div(split_moves(rise_cond(False))[0], split_moves(rise_cond(False))[0] + split_moves(rise_cond(True))[0]) - div(split_moves(rise_cond(True))[0], split_moves(rise_cond(True))[0] + split_moves(rise_cond(False))[0]),
    51: div(split_moves(rise_cond(False))[0], sum(split_moves(rise_cond(False)), lit(0))),
    52: div(total(greater(h - delay(typical), 0), 26), total(greater(delay(typical) - l, 0), 26)) * 100,
    53: count_true(up, 12) / 12 * 100,
    54: _alpha054(),
    55: total(swing(), 20),
    56: indicator(lt(R(o - ts_min(o, 12)), R(power(R(corr(total(mid, 19), total(mean(v, 40), 19), 13)), 5)))),
    57: S(place(9), 3, 1),
    58: count_true(up, 20) / 20 * 100,
    59: range_sum(20, l),
    60: total(balance() * v, 20),
    61: -greater(R(D(delta(w, 1), 12)), R(D(R(corr(l, mean(v, 80), 8)), 17))),
    62: -corr(h, R(v), 5),
    63: strength(c, 6),
    64: -greater(R(D(corr(R(w), R(v), 4), 4)), R(D(ts_max(corr(R(c), R(mean(v, 60)), 4), 13), 14))),
    65: div(mean(c, 6), c),
    66: over(c, 6),
    67: strength(c, 24),
    68: S(div((mid - (delay(h) + delay(l)) / 2) * (h - l), v), 15, 2),
    69: demand(),
    70: std(amount, 6),
    71: over(c, 24),
    72: S(fall(6), 15, 1),
    73: -(ts_rank(D(D(corr(c, v, 10), 16), 4), 5) - R(D(corr(w, mean(v, 30), 4), 3))),
    74: R(corr(total(l * 0.35 + w * 0.65, 20), total(mean(v, 40), 20), 7)) + R(corr(R(w), R(v), 6)),
    75: div(count_true(gt(c, o) & _down_market(), 50), count_true(_down_market(), 50)),
    76: div(std(_ratio_std(), 20), mean(_ratio_std(), 20)),
    77: less(R(D(mid + h - (w + h), 20)), R(D(corr(mid, mean(v, 40), 3), 6))),
    78: div(typical - mean(typical, 12), 0.015 * mean(abs_(c - mean(typical, 12)), 12)),
    79: strength(c, 12),
    80: pct(v, 5),
    81: S(v, 21, 2),
    82: S(fall(6), 20, 1),
    83: -R(ts_cov(R(h), R(v), 5)),
    84: total(either((up, v), (down, 0), (same, -v)), 20),
    85: ts_rank(div(v, mean(v, 20)), 20) * ts_rank(-delta(c, 7), 8),
    86: where(gt(slow_gap(c), 0.25), -1, where(lt(slow_gap(c), 0), 1, -d1)),
    87: -(R(D(delta(w, 4), 7)) + ts_rank(D(div(l * 0.9 + l * 0.1 - w, o - mid), 11), 7)),
    88: pct(c, 20),
    89: 2 * ((S(c, 13, 2) - S(c, 27, 2)) - S(S(c, 13, 2) - S(c, 27, 2), 10, 2)),
    90: -R(corr(R(w), R(v), 5)),
    91: -(R(c - ts_max(c, 5)) * R(corr(mean(v, 40), l, 5))),
    92: -greater(R(D(delta(c * 0.35 + w * 0.65, 2), 3)), ts_rank(D(abs_(corr(mean(v, 180), c, 13)), 5), 15)),
    93: total(where(ge(o, delay(o)), 0, greater(o - l, o - delay(o))), 20),
    94: signed_volume(30),
    95: std(amount, 20),
    96: S(S(place(9), 3, 1), 3, 1),
    97: std(v, 10),
    98: where(le(div(delta(total(c, 100) / 100, 100), delay(c, 100)), 0.05), -(c - ts_min(c, 100)), -delta(c, 3)),
    99: -R(ts_cov(R(c), R(v), 5)),
    100: std(v, 20),
    101: indicator(lt(R(corr(c, total(mean(v, 30), 37), 15)), R(corr(R(h * 0.1 + w * 0.9), R(v), 11)))),
    102: strength(v, 6),
    103: (20 - lowday(l, 20)) / 20 * 100,
    104: -(delta(corr(h, v, 5), 5) * R(std(c, 20))),
    105: -corr(R(o), R(v), 10),
    106: delta(c, 20),
    107: -R(o - delay(h)) * R(o - p1) * R(o - delay(l)),
    108: -power(R(h - ts_min(h, 2)), R(corr(w, mean(v, 120), 6))),
    109: div(S(h - l, 10, 2), S(S(h - l, 10, 2), 10, 2)),
    110: div(total(greater(h - p1, 0), 20), total(greater(p1 - l, 0), 20)) * 100,
    111: S(v * balance(), 11, 2) - S(v * balance(), 4, 2),
    112: _alpha112(),
    113: -(R(total(delay(c, 5), 20) / 20) * corr(c, v, 2) * R(corr(total(c, 5), total(c, 20), 2))),
    114: div(R(delay(div(h - l, total(c, 5) / 5), 2)) * R(R(v)), div(div(h - l, total(c, 5) / 5), w - c)),
    115: power(R(corr(h * 0.9 + c * 0.1, mean(v, 30), 10)), R(corr(ts_rank(mid, 4), ts_rank(v, 10), 7))),
    116: regbeta(c, 20),
    117: ts_rank(v, 32) * (1 - ts_rank(c + h - l, 16)) * (1 - ts_rank(r, 32)),
    118: div(total(h - o, 20), total(o - l, 20)) * 100,
    119: R(D(corr(w, total(mean(v, 5), 26), 5), 7)) - R(D(ts_rank(ts_min(corr(R(o), R(mean(v, 15)), 21), 9), 7), 8)),
    120: div(R(w - c), R(w + c)),
    121: -power(R(w - ts_min(w, 12)), ts_rank(corr(ts_rank(w, 20), ts_rank(mean(v, 60), 2), 18), 3)),
    122: div(delta(triple(log(c), 13, 2), 1), delay(triple(log(c), 13, 2))),
    123: neg(lt(R(corr(total(mid, 20), total(mean(v, 60), 20), 9)), R(corr(l, v, 6)))),
    124: div(c - w, D(R(ts_max(c, 30)), 2)),
    125: div(R(D(corr(w, mean(v, 80), 17), 20)), R(D(delta(c * 0.5 + w * 0.5, 3), 16))),
    126: typical,
    127: power(mean(power(div(100 * (c - ts_max(c, 12)), ts_max(c, 12)), 2), 12), 0.5),
    128: _alpha128(),
    129: total(where(lt(d1, 0), abs_(d1), 0), 12),
    130: div(R(D(corr(mid, mean(v, 40), 9), 10)), R(D(corr(R(w), R(v), 7), 3))),
    131: power(R(delta(w, 1)), ts_rank(corr(c, mean(v, 50), 18), 18)),
    132: mean(amount, 20),
    133: (20 - highday(h, 20)) / 20 * 100 - (20 - lowday(l, 20)) / 20 * 100,
    134: pct(c, 12) / 100 * v,
    135: S(delay(div(c, delay(c, 20))), 20, 1),
    136: -R(delta(r, 3)) * corr(o, v, 10),
    137: swing(),
    138: -(R(D(delta(l * 0.7 + w * 0.3, 3), 20)) - ts_rank(D(ts_rank(corr(ts_rank(l, 8), ts_rank(mean(v, 60), 17), 5), 19), 16), 7)),
    139: -corr(o, v, 10),
    140: less(R(D((R(o) + R(l)) - (R(h) + R(c)), 8)), ts_rank(D(corr(ts_rank(c, 8), ts_rank(mean(v, 60), 20), 8), 7), 3)),
    141: -R(corr(R(h), R(mean(v, 15)), 9)),
    142: -R(ts_rank(c, 10)) * R(delta(delta(c, 1), 1)) * R(ts_rank(div(v, mean(v, 20)), 5)),
    143: MISSING,
    144: div(sumif(div(abs_(r), amount), 20, down), count_true(down, 20)),
    145: div(mean(v, 9) - mean(v, 26), mean(v, 12)) * 100,
    146: _alpha146(),
    147: regbeta(mean(c, 12), 12),
    148: neg(lt(R(corr(o, total(mean(v, 60), 9), 6)), R(o - ts_min(o, 14)))),
    149: MISSING,
    150: typical * v,
    151: S(delta(c, 20), 20, 1),
    152: _alpha152(),
    153: (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / 4,
    154: indicator(lt(w - ts_min(w, 16), corr(w, mean(v, 180), 18))),
    155: _volume_gap(13, 27) - S(_volume_gap(13, 27), 10, 2),
    156: -greater(R(D(delta(w, 5), 3)), R(D(-div(delta(o * 0.15 + l * 0.85, 2), o * 0.15 + l * 0.85), 3))),
    157: ts_min(product(R(R(log(total(ts_min(R(R(-R(delta(c - 1, 5)))), 2), 1)))), 1), 5) + ts_rank(delay(-r, 6), 5),
    158: div((h - S(c, 15, 2)) - (l - S(c, 15, 2)), c),
    159: (oscillator(6) * 12 * 24 + oscillator(12) * 6 * 24 + oscillator(24) * 6 * 24) * 100 / (6 * 12 + 6 * 24 + 12 * 24),
    160: S(_std_if(le(c, p1)), 20, 1),
    161: mean(greater(greater(h - l, abs_(p1 - h)), abs_(p1 - l)), 12),
    162: _alpha162(),
    163: R(-r * mean(v, 20) * w * (h - c)),
    164: _alpha164(),
    165: spread(48),
    166: div(-20 * 19**1.5 * total(r - mean(r, 20), 20), 19 * 18 * power(total(power(mean(div(c, p1), 20), 2), 20), 1.5)),
    167: total(where(gt(d1, 0), d1, 0), 12),
    168: -div(v, mean(v, 20)),
    169: _alpha169(),
    170: div(R(div(1, c)) * v, mean(v, 20)) * div(h * R(h - c), total(h, 5) / 5) - R(w - delay(w, 5)),
    171: div(-(l - c) * power(o, 5), (c - h) * power(c, 5)),
    172: directional(),
    173: 3 * S(c, 13, 2) - 2 * S(S(c, 13, 2), 13, 2) + triple(log(c), 13, 2),
    174: S(_std_if(up), 20, 1),
    175: mean(greater(greater(h - l, abs_(p1 - h)), abs_(p1 - l)), 6),
    176: corr(R(div(c - ts_min(l, 12), ts_max(h, 12) - ts_min(l, 12))), R(v), 6),
    177: (20 - highday(h, 20)) / 20 * 100,
    178: r * v,
    179: R(corr(w, v, 4)) * R(corr(R(l), R(mean(v, 50)), 12)),
    180: where(lt(mean(v, 20), v), -ts_rank(abs_(delta(c, 7)), 60) * sign(delta(c, 7)), -v),
    181: _alpha181(),
    182: count_true((gt(c, o) & gt(bc, bo)) | (lt(c, o) & lt(bc, bo)), 20) / 20,
    183: spread(24),
    184: R(corr(delay(o - c), c, 200)) + R(o - c),
    185: R(-power(1 - div(o, c), 2)),
    186: (directional() + delay(directional(), 6)) / 2,
    187: total(where(le(o, delay(o)), 0, greater(h - o, o - delay(o))), 20),
    188: div(h - l - S(h - l, 11, 2), S(h - l, 11, 2)) * 100,
    189: mean(abs_(c - mean(c, 6)), 6),
    190: MISSING,
    191: corr(mean(v, 20), l, 5) + mid - c,
}

def factors() -> dict[str, Expr]:
    return {f"alpha{n:03d}": x for n, x in FACTORS.items()}
