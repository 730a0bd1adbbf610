"""Seed families of a factor search: names, formulas and the direction in which a factor is meant."""

from __future__ import annotations

from dataclasses import dataclass

from quantloom.catalog import formulaic101
from quantloom.functions.expr import Expr, abs_, add, bucket_sum, cs_mean, delay, delta, div, field, greater, gt, indicator, lt, mul, neg, regression_rsq, sub, ts_corr, ts_cov, ts_max, ts_mean, ts_min, ts_quantile, ts_rank, ts_sorted_mean_spread, ts_std, ts_sum, volume_weighted_mean, weighted_mean

o, h, l, c, v, w, amount, turnover = (field(n) for n in ("open", "high", "low", "close", "volume", "vwap", "amount", "turnover"))  # noqa: E741
r = div(c, delay(c)) - 1
market = field("benchmark_close")
E = 1e-12


@dataclass(frozen=True)
class Seed:
    family: str
    name: str
    expr: Expr
    direction: int = 1


def salience() -> Expr:
    m = cs_mean(r)
    return mul(div(abs_(sub(r, m)), add(add(abs_(r), abs_(m)), 0.1)), r)


def _amplitude_part(n: int, top: bool) -> Expr:
    state = gt(ts_rank(c, n), 0.8) if top else lt(ts_rank(c, n), 0.2)
    on = indicator(state)
    return div(ts_sum((div(h, l + E) - 1) * on, n), ts_sum(on, n) + E)


def _reversal() -> Expr:
    return mul(indicator(lt(div(o, delay(c)) - 1, 0)), indicator(gt(div(c, o) - 1, 0)))


def seeds() -> list[Seed]:
    a101 = formulaic101.FACTORS
    rate = div(turnover, 100)
    amp = div(h, l + E) - 1
    down = greater(delay(v) - v, 0)
    out = [
        Seed("open_volume_correlation", "alpha003", a101[3]),
        Seed("open_volume_correlation", "alpha006", a101[6]),
        Seed("close_volume_covariance", "alpha013", a101[13]),
        Seed("high_volume_covariance", "alpha016", a101[16]),
        Seed("high_ranked_volume_correlation", "alpha044", a101[44]),
        Seed("high_volatility_times_volume_correlation", "alpha040", a101[40]),
        Seed("industry_neutral_nonlinear_flow", "alpha069", a101[69]),
        Seed("amount_volatility", "amount_std_20", ts_std(amount, 20), -1),
        Seed("amount_level", "amount_mean_20", ts_mean(amount, 20), -1),
        Seed("salience_panic_score", "std_score_60", ts_std(salience(), 60), -1),
        Seed("salience_panic_score", "terrified_score_60", mul(0.5, ts_mean(salience(), 60) + ts_std(salience(), 60)), -1),
        Seed("amplitude_structure", "amplitude_spread_5", _amplitude_part(5, True) - _amplitude_part(5, False)),
        Seed("amplitude_structure", "amplitude_high_20", _amplitude_part(20, True)),
        Seed("lower_shadow_stability", "downshadow_std_63", ts_std(div(c - l, l), 63), -1),
        Seed("price_bias", "apb_5", div(ts_mean(w, 5), volume_weighted_mean(w, v, 5)) - 1),
        Seed("price_bias", "apb_30", div(ts_mean(w, 30), volume_weighted_mean(w, v, 30)) - 1),
        Seed("weighted_price_centroid", "vwap_minus_mean_5", volume_weighted_mean(c, v, 5) - ts_mean(c, 5)),
        Seed("weighted_price_centroid", "vwap_minus_mean_30", volume_weighted_mean(c, v, 30) - ts_mean(c, 30)),
        Seed("relative_volume_pressure", "volume_mean30_over_volume", div(ts_mean(v, 30), v + E)),
        Seed("relative_volume_pressure", "volume_mean60_over_volume", div(ts_mean(v, 60), v + E)),
        Seed("relative_volume_pressure", "down_volume_share_30", div(ts_sum(down, 30), ts_sum(abs_(v - delay(v)), 30) + E)),
        Seed("downside_price_position", "low_over_high", div(l, h)),
        Seed("downside_price_position", "low_minus_high_over_prev_close", div(l - h, delay(c) + E)),
        Seed("downside_price_position", "low5min_over_close", div(ts_min(l, 5), c)),
        Seed("downside_price_position", "low10min_over_close", div(ts_min(l, 10), c)),
        Seed("downside_price_position", "low_over_close", div(l, c)),
        Seed("historical_anchor_ratio", "close_mean60_over_close", div(ts_mean(c, 60), c)),
        Seed("historical_anchor_ratio", "close_quantile10_over_close", div(ts_quantile(c, 10, 0.2), c)),
        Seed("historical_anchor_ratio", "open_quantile5_over_close", div(ts_quantile(o, 5, 0.2), c)),
        Seed("return_open_marketfit", "cov_ret_open_beta_r2_abs", abs_(ts_cov(r, o, 5) + regression_rsq(r, div(market, delay(market)) - 1, 60))),
        Seed("daytime_reversal", "positive_intraday_reversal_frequency_20", ts_mean(_reversal(), 20)),
        Seed("abnormal_volume_attention", "abnormal_volume_average_20", ts_mean(div(v, ts_mean(v, 242) + E), 20)),
        Seed("abnormal_volume_attention", "abnvold_20", ts_max(div(v, ts_mean(v, 242) + E), 20)),
        Seed("weighted_upper_shadow", "weighted_upper_shadow_frequency_40_hl10", weighted_mean(indicator(gt(div(h - greater(o, c), delay(c)), 0.01)), 40, 10), -1),
        Seed("ideal_amplitude_structure", "ideal_amplitude_20_q25", ts_sorted_mean_spread(amp, c, 20, 0.25), -1),
    ]
    for n in (60, 120):
        out.append(Seed("amplitude_sliced_momentum", f"amp_spread_ret_{n}_q30", bucket_sum(r, amp, n, 0.3, "low") - bucket_sum(r, amp, n, 0.3, "high")))
        out.append(Seed("high_amplitude_reversal", f"amp_high_ret_{n}_q30", bucket_sum(r, amp, n, 0.3, "high"), -1))
    out.append(Seed("high_amplitude_reversal", "mmt_range_21_q20", bucket_sum(r, amp, 21, 0.2, "high") - bucket_sum(r, amp, 21, 0.2, "low")))
    for name, x in (("low", "low"), ("high", "high")):
        out.append(Seed(f"{name}_price_pressure", f"{name}_price_volume_share_20", div(bucket_sum(v, c, 20, 0.3, x), ts_sum(v, 20)), 1 if x == "low" else -1))
    out += [
        Seed("turnover_structure", "close_bias_turnover_corr_15", neg(ts_corr(c - ts_mean(w, 10), rate, 15))),
        Seed("turnover_structure", "vwap_delta_turnover_corr_15", neg(ts_corr(delta(w, 3), div(rate, ts_std(r, 10) + E), 15))),
        Seed("turnover_structure", "vwap_turnover_cov_10", neg(ts_cov(w, turnover, 10))),
    ]
    return out


def factors(oriented: bool = True) -> dict[str, Expr]:
    """Each seed once by name; turned so that larger is better where a direction says so."""
    return {s.name: (neg(s.expr) if oriented and s.direction < 0 else s.expr) for s in seeds()}
