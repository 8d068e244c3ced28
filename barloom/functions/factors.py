"""The named factors, by family. A factor is an expression over bars(symbol, ts, open, high, low, close, volume, extras).

``alpha`` families take max(2, n//2) values as the least of a window; all others need the full window.
"""

from __future__ import annotations

from .expr import (
    EPS, Expr, absolute, col, corr, cov, decay_linear, delta, ewm, fit_r2, fit_residual, flag, fn, high_of, kurt, lag, larger, last_known, lift, ln, low_of, mean,
    or_zero, pct, place_of, power, quantile, rank_of_last, roll, running, sign, skew, slope, smaller, sqrt, std, total, unless, weighted, when, whole, win,
)

O, H, L, C, V = (col(x) for x in ("open", "high", "low", "close", "volume"))
RET = pct(C)
TYPICAL = (H + L + C) / 3.0
FIELDS = {"open": O, "high": H, "low": L, "close": C, "vwap": TYPICAL}
W5 = (5, 10, 20, 30, 60)
FAMILIES: dict[str, dict[str, Expr]] = {}


def family(name: str, factors: dict[str, Expr]) -> None:
    FAMILIES.setdefault(name, {}).update(factors)


def half(n: int) -> int:
    return max(2, n // 2)


def each(pattern: str, windows, build) -> dict[str, Expr]:
    return {pattern.format(w): build(w) for w in windows}


# ---- one-bar shapes and lags ---------------------------------------------------
top, bottom, span = larger(O, C), smaller(O, C), H - L
family("alpha158_bar", {
    "alpha158_kmid": (C - O) / (O + EPS), "alpha158_klen": span / (O + EPS), "alpha158_kmid2": (C - O) / (span + EPS), "alpha158_kup": (H - top) / (O + EPS),
    "alpha158_kup2": (H - top) / (span + EPS), "alpha158_klow": (bottom - L) / (O + EPS), "alpha158_klow2": (bottom - L) / (span + EPS),
    "alpha158_ksft": (2 * C - H - L) / (O + EPS), "alpha158_ksft2": (2 * C - H - L) / (span + EPS),
})
family("alpha158_lags", {f"alpha158_{f}_lag_{k}": lag(FIELDS[f], k) / (C + EPS) for f in ("open", "high", "low", "vwap") for k in range(5)})
family("alpha158_lags", {f"alpha158_vol_lag_{k}": lag(V, k) / (V + EPS) for k in range(1, 5)})
family("alpha158_lags", {"alpha158_vwma_5": total(V * C, 5, 2) / (total(V, 5, 2) + EPS)})

# ---- rolling families of five windows --------------------------------------------
up, down = larger(delta(C), 0.0), larger(-delta(C), 0.0)
swing = absolute(RET) * V
share_up = lambda w: mean(flag(C > lag(C)), w, half(w))
share_down = lambda w: mean(flag(C < lag(C)), w, half(w))
gains = lambda w: total(unless(up, lag(C)), w, half(w)) / (total(absolute(delta(C)), w, half(w)) + EPS)
high_at = lambda w: place_of("max", H, w, half(w))
low_at = lambda w: place_of("min", L, w, half(w))
ALPHA158 = {
    "ma": lambda w: mean(C, w, half(w)) / (C + EPS), "std": lambda w: std(C, w, half(w)) / (C + EPS), "beta": lambda w: (C - lag(C, w)) / (C * w + EPS),
    "rsqr": lambda w: fit_r2(C, w), "resi": lambda w: fit_residual(C, w) / (C + EPS), "max": lambda w: high_of(H, w, half(w)) / (C + EPS),
    "min": lambda w: low_of(L, w, half(w)) / (C + EPS), "qtlu": lambda w: quantile(H, w, 0.8, half(w)) / (C + EPS), "qtld": lambda w: quantile(L, w, 0.2, half(w)) / (C + EPS),
    "rank": lambda w: rank_of_last(C, w, half(w)), "rsv": lambda w: (C - low_of(L, w, half(w))) / (high_of(H, w, half(w)) - low_of(L, w, half(w)) + EPS),
    "imax": lambda w: high_at(w) / w, "imin": lambda w: low_at(w) / w, "imxd": lambda w: (high_at(w) - low_at(w)) / w,
    "corr": lambda w: corr(C, ln(V + 1.0), w, half(w)), "cord": lambda w: corr(C / (lag(C) + EPS), ln(V / (lag(V) + EPS) + 1.0), w, half(w)),
    "cntp": share_up, "cntn": share_down, "cntd": lambda w: share_up(w) - share_down(w), "sump": gains, "sumn": lambda w: 1.0 - gains(w), "sumd": lambda w: 2.0 * gains(w) - 1.0,
    "vma": lambda w: mean(V, w, half(w)) / (V + EPS), "vstd": lambda w: std(V, w, half(w)) / (V + EPS),
    "wvma": lambda w: std(swing, w, half(w)) / (mean(swing, w, half(w)) + EPS),
}
for name, build in ALPHA158.items():
    family(f"alpha158_{name}", each(f"alpha158_{name}_{{}}", W5 if name != "sumd" else W5[:4], build))

# ---- price history by Fibonacci lags ----------------------------------------------
family("alpha360", {f"alpha360_close_lag_{k}": lag(C, k) / (C + EPS) for k in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)})
family("alpha360", {f"alpha360_{f}_lag_{k}": lag(FIELDS[f], k) / (C + EPS) for f in ("open", "high", "low", "vwap") for k in (1, 5, 21)})
family("alpha360", {f"alpha360_volume_lag_{k}": lag(V, k) / (V + EPS) for k in (1, 5, 21)})
family("alpha360", {
    "alpha360_close_ratio_1_20": lag(C, 1) / (lag(C, 20) + EPS), "alpha360_close_ratio_5_60": lag(C, 5) / (lag(C, 60) + EPS),
    "alpha360_volume_ratio_1_20": lag(V, 1) / (lag(V, 20) + EPS), "alpha360_hl_range_lag_5": lag(span, 5) / (C + EPS), "alpha360_ohlc_avg_lag_1": lag((O + H + L + C) / 4.0) / (C + EPS),
})

# ---- published formulaic alphas, cross-sectional ranks left out ---------------------
acorr = lambda a, b, n: corr(a, b, n, half(n))
arank = lambda x, n: rank_of_last(x, n, half(n))
asum = lambda x, n: total(x, n, half(n))
astd = lambda x, n: std(x, n, half(n))
amean = lambda x, n: mean(x, n, half(n))
amax = lambda x, n: high_of(x, n, half(n))
amin = lambda x, n: low_of(x, n, half(n))
adv20, D1, D7 = amean(V, 20), delta(C, 1), delta(C, 7)


def trend_switch(n: int) -> Expr:
    """The close's move, reversed unless the last n moves had one sign."""
    return when(lift(0.0) < amin(D1, n), D1, when(amax(D1, n) < 0.0, D1, -D1))


bend = (lag(C, 20) - lag(C, 10)) / 10.0 - (lag(C, 10) - C) / 10.0
base8 = asum(C, 8) / 8.0
loss_or_close = when(RET < 0.0, astd(RET, 20), C)
tr21, move5 = arank(TYPICAL - amax(TYPICAL, 15), 21), smaller(absolute(delta(C, 5)), 10.0)
WQ101 = {
    "001": place_of("max", sign(loss_or_close) * power(absolute(loss_or_close), 2), 5, 2) / 5.0 - 0.5, "002": -acorr(delta(ln(V), 2), (C - O) / (O + EPS), 6), "003": -acorr(O, V, 10), "004": -arank(L, 9),
    "005": (O - amean(TYPICAL, 10)) * -absolute(C - TYPICAL), "006": -acorr(O, V, 10), "007": when(adv20 < V, -arank(absolute(D7), 60) * sign(D7), -1.0),
    "008": -(asum(O, 5) * asum(RET, 5) - lag(asum(O, 5) * asum(RET, 5), 10)), "009": trend_switch(5), "010": trend_switch(4), "012": sign(delta(V)) * -D1, "013": -cov(C, V, 5, 2),
    "014": -delta(RET, 3) * acorr(O, V, 10), "015": -asum(acorr(H, V, 3), 3), "016": -cov(H, V, 5, 2), "018": -(astd(absolute(C - O), 5) + (C - O) + acorr(C, O, 10)),
    "019": -sign((C - lag(C, 7)) + D7) * (2.0 + asum(RET, 250)), "020": -(O - lag(H)) * (O - lag(C)) * (O - lag(L)),
    "021": when(base8 + astd(C, 8) < asum(C, 2) / 2.0, -1.0, when(asum(C, 2) / 2.0 < base8 - astd(C, 8), 1.0, when(V / (adv20 + EPS) >= 1.0, 1.0, -1.0))),
    "022": -delta(acorr(H, V, 5), 5) * astd(C, 20), "028": acorr(adv20, L, 5) + (H + L) / 2.0 - C, "034": (1.0 - astd(RET, 2) / (astd(RET, 5) + EPS)) + (1.0 - D1),
    "035": arank(V, 32) * (1.0 - arank(C + H - L, 16)) * (1.0 - arank(RET, 32)), "037": acorr(lag(O - C), C, 60) + (O - C), "038": -arank(C, 10) * (C / (O + EPS)), "040": -astd(H, 10) * acorr(H, V, 10),
    "043": arank(V / (adv20 + EPS), 20) * arank(-D7, 8), "046": when(bend > 0.25, -1.0, when(bend < 0.0, 1.0, -D1)), "049": when(bend < -0.1, 1.0, -D1), "050": -amax(acorr(V, TYPICAL, 5), 5),
    "051": when(bend < -0.05, 1.0, -D1), "053": -delta(((C - L) - (H - C)) / (C - L + EPS), 9), "054": -((L - C) * power(O, 5)) / ((L - H) * power(C, 5) + EPS),
    "055": -acorr((C - amin(L, 12)) / (amax(H, 12) - amin(L, 12) + EPS), V, 6), "083": lag(span / (asum(C, 5) / 5.0 + EPS), 2) * V / ((span / (asum(C, 5) / 5.0 + EPS)) / (TYPICAL - C + EPS) + EPS),
    "084": sign(delta(C, 5)) * fn("pow(abs({0}), {1})", tr21, move5), "099": when(acorr(asum((H + L) / 2.0, 20), asum(amean(V, 60), 20), 9) < acorr(L, V, 6), -1.0, 1.0), "101": (C - O) / (span + 0.001),
}
family("wq101_a", {f"wq101_alpha{k}": v for k, v in WQ101.items() if int(k) < 20})
family("wq101_b", {f"wq101_alpha{k}": v for k, v in WQ101.items() if int(k) >= 20})

# ---- momentum and sentiment signals ---------------------------------------------------
pm5, vm5, tr10 = delta(C, 5) / lag(C, 5), delta(V, 5) / lag(V, 5), absolute(delta(C, 10)) / lag(C, 10)
pos20 = (C - low_of(L, 20)) / (high_of(H, 20) - low_of(L, 20))
mood10 = flag((C > mean(C, 10)) & (V > mean(V, 10)))
before = lambda agg, x, n: fn("CASE WHEN {0} >= %d THEN {1} END" % n, win("count({0})", x, frame=(-n, -1)), win(agg + "({0})", x, frame=(-n, -1)))
family("hazel", {f"Hazel-raw_{k}": v + 0.0 for k, v in (("close", C), ("high", H), ("low", L), ("open", O), ("volume", V))})
family("hazel", {
    "Hazel-short_price_change_1": delta(C) / lag(C), "Hazel-volume_momentum_5": vm5, "Hazel-momentum_strength": absolute(pm5) * vm5, "Hazel-price_acceleration": delta(RET), "Hazel-volume_acceleration": delta(vm5),
    "Hazel-trend_strength_10": tr10, "Hazel-trend_consistency_3": flag((C > lag(C)) & (lag(C) > lag(C, 2)) & (lag(C, 2) > lag(C, 3))), "Hazel-volatility_change": delta(std(C, 10) / mean(C, 10)),
    "Hazel-price_position_20": pos20, "Hazel-price_breakout_20": flag(C > before("max", C, 20)), "Hazel-price_breakdown_20": flag(C < before("min", C, 20)), "Hazel-volume_breakout_20": flag(V > before("max", V, 20)),
    "Hazel-price_reversal": flag((C > lag(C)) & (lag(C) < lag(C, 2))), "Hazel-volume_price_ratio": V / C, "Hazel-volume_price_divergence": when((pm5 > 0.0) & (vm5 < 0.0), 1.0, when((pm5 < 0.0) & (vm5 > 0.0), -1.0, 0.0)),
    "Hazel-market_sentiment_10": mood10, "Hazel-technical_score": 0.3 * pm5 + 0.2 * vm5 + 0.2 * tr10 + 0.15 * pos20 + 0.15 * mood10,
})

# ---- classic single-window statistics ----------------------------------------------------
W6 = (5, 10, 20, 50, 100, 200)
family("rolling_level", each("rolling_mean_{}", (5, 10, 50, 100, 200), lambda w: mean(C, w)) | each("rolling_std_{}", W6, lambda w: std(C, w)) | each("cv_{}", W6, lambda w: std(C, w) / mean(C, w)) | each("zscore_{}", (5, 20, 50, 100, 200), lambda w: or_zero((C - mean(C, w)) / std(C, w))) | {"sma": mean(C, 20), "rvi": (C - mean(C, 10)) / std(C, 10), "mayer_multiple": C / mean(C, 200)})
family("rolling_quantile", {f"q{q}_{w}": quantile(C, w, q / 100.0) for q in (25, 75, 90) for w in W6})
family("rolling_shape", each("skewness_{}", W6, lambda w: skew(C, w)) | each("kurtosis_{}", W6, lambda w: kurt(C, w)) | each("returns_skew_{}", (20, 50, 100), lambda w: skew(RET, w)) | each("returns_kurt_{}", (20, 50, 100), lambda w: kurt(RET, w)))
PAIRS = [(5, 10), (5, 20), (5, 50), (10, 20), (10, 50), (20, 50)]
over = lambda a, b: flag(mean(C, a) > mean(C, b))
family("ma_pairs", {f"ma_cross_{a}_{b}": delta(over(a, b)) for a, b in PAIRS} | {f"ma_distance_{a}_{b}": (mean(C, a) - mean(C, b)) / mean(C, b) for a, b in PAIRS})
close_pos = lambda w: (C - low_of(C, w)) / (high_of(C, w) - low_of(C, w))
vol = lambda w: std(RET, w)
family("returns", {"momentum": pct(C, 10), "momentum_5": pct(C, 5), "momentum_20": pct(C, 20), "momentum_50": pct(C, 50), "price_momentum_100": pct(C, 100), "roc": pct(C, 12)} | each("returns_momentum_{}", (5, 10, 20, 50), lambda w: mean(RET, w)) | each("returns_zscore_{}", (20, 50), lambda w: (RET - mean(RET, w)) / std(RET, w)) | each("price_reversal_{}", (20, 50, 100), lambda w: mean(flag(RET < 0.0), w)) | each("trend_consistency_{}", (20, 50), lambda w: mean(flag(RET > 0.0), w)) | each("price_position_{}", (20, 50, 100), close_pos) | {"breakout_strength": or_zero(close_pos(20))})
family("volatility", each("volatility_{}", (5, 10, 20, 50), vol) | each("volatility_change_{}", (5, 10, 20, 50), lambda w: vol(w) / lag(vol(w), w)) | each("volatility_ratio_{}", (10, 20, 50), lambda w: vol(w) / mean(vol(w), w)) | each("volatility_state_{}", (5, 10, 20, 50), lambda w: flag(vol(w) > whole("avg({0})", vol(w)))) | {f"vol_ratio_{w}_5": vol(w) / vol(5) for w in (10, 20, 50)} | {"volatility_adjusted_return": RET / lag(vol(20)), "vol_change_5": pct(V)})
auto = lambda x, w: corr(x, lag(x), w - 1)
family("rolling_corr", each("price_autocorr_{}", (20, 50, 100), lambda w: auto(C, w)) | each("volume_autocorr_{}", (20, 50, 100), lambda w: auto(V, w)) | each("price_volume_corr_{}", (20, 50, 100), lambda w: corr(RET, pct(V), w)) | each("vol_price_corr_{}", (20, 50), lambda w: corr(RET, V, w)) | {"correlation": mean((C - mean(C, 20)) * (V - mean(V, 20)), 20) / (std(C, 20) * std(V, 20))})
family("window_rank", {"percentile_rank": rank_of_last(C, 100), "price_rank_50": rank_of_last(C, 50), "volume_rank_20": rank_of_last(V, 20), "volume_rank_50": rank_of_last(V, 50)})
family("volume", each("volume_ma_{}", (20, 50), lambda w: mean(V, w)) | each("volume_ratio_{}", (20, 50), lambda w: V / mean(V, w)) | {"volume_ratio": mean(V, 5) / mean(V, 20)})

# ---- indicators: means, channels, oscillators ------------------------------------------------
prior = lag(C)
TR = larger(span, absolute(H - prior), absolute(L - prior))
atr = lambda n: mean(TR, n)
plus_move, minus_move = delta(H), -delta(L)
PDM, MDM = when((plus_move > minus_move) & (plus_move > 0.0), plus_move, 0.0), when((minus_move > plus_move) & (minus_move > 0.0), minus_move, 0.0)
di = lambda m, n: 100.0 * mean(m, n) / mean(TR, n)
adx = lambda n: or_zero(mean(100.0 * absolute(di(PDM, n) - di(MDM, n)) / (di(PDM, n) + di(MDM, n)), n))
family("directional", {"adx": adx(14), "adx_20": adx(20), "adx_50": adx(50), "di_plus_20": or_zero(di(PDM, 20)), "di_plus_50": or_zero(di(PDM, 50)), "di_minus_20": or_zero(di(MDM, 20)), "di_minus_50": or_zero(di(MDM, 50)), "atr": atr(14), "atr_21": atr(21), "atr_ratio_14": atr(14) / C, "atr_ratio_21": atr(21) / C})
aroon = lambda which, x: or_zero(100.0 - 100.0 * (25.0 - place_of(which, x, 25)) / 24.0)
mid = lambda n: (high_of(H, n) + low_of(L, n)) / 2.0
family("channels", {
    "aroon_up": aroon("max", H), "aroon_down": aroon("min", L), "aroon_oscillator": aroon("max", H) - aroon("min", L), "bb_upper": mean(C, 20) + 2.0 * std(C, 20), "bb_lower": mean(C, 20) - 2.0 * std(C, 20),
    "donchian_upper": high_of(H, 20), "donchian_lower": low_of(L, 20), "donchian_middle": mid(20), "ichimoku_tenkan": mid(9), "ichimoku_kijun": mid(26), "ichimoku_senkou_a": lag((mid(9) + mid(26)) / 2.0, 26),
    "ichimoku_senkou_b": lag(mid(52), 26), "ichimoku_chikou": or_zero(last_known(lag(C, 26))), "resistance_level": high_of(H, 20), "support_level": low_of(L, 20), "resistance_distance": (high_of(H, 50) - C) / C,
    "support_distance": (C - low_of(C, 20)) / C, "price_range": span / C, "heikin_ashi_close": (O + H + L + C) / 4.0, "balance_of_power": or_zero((C - O) / span),
})


def rsi_of(x: Expr, n: int) -> Expr:
    """Ratio of simple means of rises and falls; 100 without a fall, null without either."""
    gain, loss = mean(larger(x, 0.0), n), mean(larger(-x, 0.0), n)
    return fn("CASE WHEN {1} = 0 AND {0} > 0 THEN 100.0D ELSE 100 - 100 / (1 + {0} / nullif({1}, 0)) END", gain, loss, duck="CASE WHEN {1} = 0 AND {0} > 0 THEN 100.0 ELSE 100 - 100 / (1 + {0} / nullif({1}, 0)) END")


move = delta(C)
gain_of = unless(larger(move, 0.0), prior)
up0, down0 = or_zero(larger(move, 0.0)), or_zero(larger(-move, 0.0))
rises = lambda n: rsi_of(unless(move, prior), n)
stoch = lambda n: 100.0 * (C - low_of(L, n)) / (high_of(H, n) - low_of(L, n))
stretch = lambda x, n: 100.0 * (x - low_of(x, n)) / (high_of(x, n) - low_of(x, n))
family("oscillators", {
    "rsi": rises(14), "rsi_21": rises(21), "rsi_overbought_14": flag(rises(14) > 70.0), "rsi_overbought_21": flag(rises(21) > 70.0), "rsi_oversold_14": flag(rises(14) < 30.0), "rsi_oversold_21": flag(rises(21) < 30.0),
    "stoch_k": stoch(14), "stoch_d": mean(stoch(14), 3), "stoch_overbought": flag(stoch(14) > 80.0), "stoch_oversold": flag(stoch(14) < 20.0), "stoch_rsi": mean(stretch(rises(14), 14), 3),
    "rmi": rsi_of(unless(delta(C, 5), lag(C, 5)), 20), "cci": (TYPICAL - mean(TYPICAL, 20)) / (0.015 * mean(absolute(TYPICAL - mean(TYPICAL, 20)), 20)),
    "chande_momentum": 100.0 * (total(up0, 14) - total(down0, 14)) / (total(up0, 14) + total(down0, 14)),
    "awesome_oscillator": mean((H + L) / 2.0, 5) - mean((H + L) / 2.0, 34), "dpo": lag(C, 11) - mean(C, 20), "ulcer_index": sqrt(mean(power(100.0 * (C / high_of(C, 14) - 1.0), 2), 14)),
    "coppock_curve": weighted(100.0 * (pct(C, 14) + pct(C, 11)), 10, [(10 - k) / 55.0 for k in range(10)]), "kst": total(pct(C, 10), 10) + 2.0 * total(pct(C, 15), 10) + 3.0 * total(pct(C, 20), 10) + 4.0 * total(pct(C, 30), 15),
    "wma": decay_linear(C, 20), "triangle_pattern": -(absolute(slope(H, 50)) + absolute(slope(L, 50))),
})
flow = ((C - L) - (H - C)) / span
money = TYPICAL * V
bp, true_low = C - smaller(L, prior), smaller(L, prior)
tr_b = larger(H, prior) - true_low
ult = lambda n: total(bp, n) / total(tr_b, n)
obv = running(sign(move) * V)
vi = lambda x, n: total(absolute(x), n) / total(TR, n)
family("volume_flow", {
    "accumulation_distribution": running(or_zero(flow) * V), "chaikin_money_flow": total(flow * V, 20) / total(V, 20), "obv": obv, "obv_change": pct(obv), "obv_ma": mean(obv, 20),
    "mfi": 100.0 - 100.0 / (1.0 + total(when(delta(TYPICAL) > 0.0, money, 0.0), 14) / total(when(delta(TYPICAL) < 0.0, money, 0.0), 14)),
    "ease_of_movement": mean(delta((H + L) / 2.0) / (V / span), 14), "vwap": running(C * V) / running(V), "vwap_distance": (C - total(C * V, 20) / total(V, 20)) / (total(C * V, 20) / total(V, 20)),
    "ultimate_oscillator": 100.0 * (4.0 * ult(7) + 2.0 * ult(14) + ult(28)) / 7.0, "vortex_oscillator": vi(H - lag(L), 14) - vi(L - lag(H), 14),
})

# ---- candles and gaps ----------------------------------------------------------------------------
body, upper, lower_shadow = absolute(C - O), H - top, bottom - L
pbody = lag(body)
five = win("count({0})", H, frame=(-2, 2))  # no fractal at the ends of a history
family("candles", {
    "doji": flag(body / span <= 0.001), "hammer": flag((lower_shadow >= 2.0 * body) & (upper <= 0.3 * body)), "shooting_star": flag((upper >= 2.0 * body) & (lower_shadow <= 0.3 * body)),
    "engulfing_bullish": flag((lag(C) < lag(O)) & (C > O) & (O <= lag(C)) & (C >= lag(O)) & (body >= 0.5 * pbody)), "engulfing_bearish": flag((lag(C) > lag(O)) & (C < O) & (O >= lag(C)) & (C <= lag(O)) & (body >= 0.5 * pbody)),
    "morning_star": flag((lag(C, 2) < lag(O, 2)) & (pbody <= 0.3 * mean(body, 3)) & (C > O) & (C > (lag(O, 2) + lag(C, 2)) / 2.0)), "evening_star": flag((lag(C, 2) > lag(O, 2)) & (pbody <= 0.3 * mean(body, 3)) & (C < O) & (C < (lag(O, 2) + lag(C, 2)) / 2.0)),
    "fractal_up": flag((H >= win("max({0})", H, frame=(-2, 2))) & (five >= 5.0)), "fractal_down": flag((L <= win("min({0})", L, frame=(-2, 2))) & (five >= 5.0)), "gap_up": or_zero(larger(O - prior, 0.0)), "gap_down": or_zero(larger(prior - O, 0.0)),
    "gap_fill": flag((C - prior) * (O - prior) <= 0.0), "technical_mining_doji_5": flag(body / span < 0.1), "technical_mining_long_lower_shadow_5": flag((lower_shadow > 2.0 * body) & (C > O)),
})
family("mined", {
    "technical_mining_bb_position_10": (C - (mean(C, 10) + 2.0 * std(C, 10))) / std(C, 10), "technical_mining_bb_upper_10": mean(C, 10) + 2.0 * std(C, 10), "technical_mining_bb_upper_5": mean(C, 5) + 2.0 * std(C, 5),
    "technical_mining_bb_width_10": 2.0 * std(C, 10) / mean(C, 10), "technical_mining_momentum_zscore_5": (RET - mean(RET, 5)) / std(RET, 5), "technical_mining_trend_strength_5": mean(flag(RET > 0.0), 5),
    "technical_mining_price_position_10": close_pos(10), "technical_mining_resistance_level_10": high_of(H, 10), "technical_mining_support_level_10": low_of(L, 10), "technical_mining_support_level_5": low_of(L, 5),
    "technical_mining_rsi_20": rises(20), "technical_mining_stoch_d_10": mean(stoch(10), 3), "technical_mining_vpt_5": running(RET * V),
} | each("technical_mining_volume_ma_{}", (5, 10), lambda w: mean(V, w)) | each("technical_mining_volume_momentum_{}", (10, 20), lambda w: mean(pct(V), w)) | each("technical_mining_volume_volatility_{}", (5, 10), lambda w: std(pct(V), w)))

# ---- exponential means -----------------------------------------------------------------------------
E12, E26 = ewm(C, 12), ewm(C, 26)
MACD, MACD_RAW = E12 - E26, ewm(C, 12, adjust=False) - ewm(C, 26, adjust=False)
E3 = ewm(ewm(ewm(C, 15), 15), 15)
adl = running(or_zero(flow) * V)
force = V * delta(TYPICAL)
ema_gain, ema_loss = ewm(gain_of, 14, adjust=False), ewm(unless(larger(-move, 0.0), prior), 14, adjust=False)
line = ewm(C, 23) - ewm(C, 50)
family("ewm", {
    "ema": ewm(C, 20), "dema": 2.0 * ewm(C, 21) - ewm(ewm(C, 21), 21), "tema": 3.0 * ewm(C, 21) - 3.0 * ewm(ewm(C, 21), 21) + ewm(ewm(ewm(C, 21), 21), 21), "trix": 100.0 * pct(E3), "macd": MACD, "macd_signal": ewm(MACD, 9),
    "macd_histogram": MACD - ewm(MACD, 9), "macd_diff": MACD_RAW - ewm(MACD_RAW, 9, adjust=False), "macd_cross": delta(flag(MACD_RAW > ewm(MACD_RAW, 9, adjust=False))), "ppo": 100.0 * MACD / E26,
    "multi_timeframe_trend": ewm(C, 20) - ewm(C, 50), "elder_ray_bull": H - ewm(C, 13), "elder_ray_bear": L - ewm(C, 13), "force_index": ewm(move * V, 13), "klinger_oscillator": ewm(force, 34) - ewm(force, 55),
    "chaikin_oscillator": ewm(adl, 3) - ewm(adl, 10), "keltner_upper": ewm(C, 20) + 2.0 * atr(20), "keltner_lower": ewm(C, 20) - 2.0 * atr(20), "tsi": 100.0 * ewm(ewm(move, 25), 13) / ewm(ewm(absolute(move), 25), 13),
    "adaptive_rsi": or_zero(100.0 - 100.0 / (1.0 + ema_gain / ema_loss)), "schaff_trend_cycle": mean(stretch(line, 10), 3),
    "guppy_mma": sum((ewm(C, n) for n in (5, 8, 10, 12, 15)), ewm(C, 3)) / 6.0 - sum((ewm(C, n) for n in (35, 40, 45, 50, 60)), ewm(C, 30)) / 6.0,
})

# ---- derivatives, funding, on-chain: extras columns -----------------------------------------------------
BASIS, OI, TAKER, FUND = col("basis"), col("open_interest"), col("taker_buy_base"), col("funding_rate")
zs = lambda x, w: (x - mean(x, w)) / std(x, w)
family("derivatives", {
    "basis_ma_deviation": BASIS - mean(BASIS, 48), "basis_zscore": zs(BASIS, 96), "lsr_retail_vs_top_spread": col("lsr_global_account") - col("lsr_top_account"), "lsr_top_position_zscore": zs(col("lsr_top_position"), 96),
    "oi_change_pct": pct(OI, 12), "oi_change_zscore": zs(pct(OI, 12), 96), "oi_to_volume_ratio": OI / mean(V, 20), "taker_buy_imbalance_zscore": zs(TAKER / V - 0.5, 48), "taker_buy_ratio": TAKER / V,
    "funding_rate_current": FUND + 0.0, "funding_rate_ma": mean(FUND, 72), "funding_rate_sign_balance": mean(or_zero(sign(FUND)), 168), "funding_rate_zscore": zs(FUND, 240), "network_value": col("circulating_supply") * C,
})

#: Fixed list: 0, not missing, where there is no value, as in the warm-up.
ZERO_WHERE_MISSING = {
    "mayer_multiple", "rvi", "volatility_adjusted_return", "correlation", "volume_ratio", "ichimoku_senkou_a", "ichimoku_senkou_b", "resistance_distance",
    "awesome_oscillator", "cci", "chande_momentum", "coppock_curve", "dpo", "kst", "triangle_pattern", "ulcer_index", "chaikin_money_flow",
    "ultimate_oscillator", "vortex_oscillator", "force_index", "klinger_oscillator", "schaff_trend_cycle", "trix", "tsi",
}
for group in FAMILIES.values():
    group.update({name: or_zero(e) for name, e in group.items() if name in ZERO_WHERE_MISSING})

FACTORS = {name: e for group in FAMILIES.values() for name, e in group.items()}
#: Factors that use later bars.
LOOKAHEAD = {"fractal_up", "fractal_down", *(f"volatility_state_{w}" for w in (5, 10, 20, 50))}
