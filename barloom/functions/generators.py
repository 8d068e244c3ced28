"""Feature sets over any windows: each generator gives named expressions, which ``evaluate`` computes in shared window passes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from .expr import Expr, absolute, corr, delta, ewm, flag, fn, high_of, kurt, lag, larger, lead, ln, low_of, mean, or_zero, pct, rank_of_last, skew, smaller, std, total
from .factors import RET, TR, C, H, L, O, V, rsi_of

TINY = 1e-8
MOVE = delta(C)
GAIN, LOSS = or_zero(larger(MOVE, 0.0)), or_zero(larger(-MOVE, 0.0))


def rsi(w: int, floor: float = TINY) -> Expr:
    """Without a floor, 100 where nothing fell and missing where nothing moved."""
    return 100.0 - 100.0 / (1.0 + mean(GAIN, w) / (mean(LOSS, w) + floor)) if floor else rsi_of(or_zero(MOVE), w)


def place(w: int, top: Expr = H, bottom: Expr = L, floor: float = TINY) -> Expr:
    return (C - low_of(bottom, w)) / (high_of(top, w) - low_of(bottom, w) + floor)


def _each(windows: Iterable[int], build: Callable[[int], dict[str, Expr]]) -> dict[str, Expr]:
    return {f"{name}_{w}": e for w in windows for name, e in build(w).items()}


def trend(windows) -> dict[str, Expr]:
    return _each(windows, lambda w: {
        "sma": mean(C, w), "price_sma_ratio": C / mean(C, w), "sma_slope": delta(mean(C, w)), "ma_cross": (mean(C, w // 2) - mean(C, w)) / mean(C, w), "price_position": place(w),
        "trend_strength": fn("CASE WHEN {0} >= %d THEN {1} END" % w, total(MOVE * 0.0 + 1.0, w), mean(flag(MOVE > 0.0), w)),
    })


def momentum(windows) -> dict[str, Expr]:
    line = ewm(C, 12) - ewm(C, 26)

    def one(w: int) -> dict[str, Expr]:
        m, k = C / lag(C, w) - 1.0, 100.0 * place(w)
        out = {"momentum": m, "momentum_zscore": (m - mean(m, 2 * w)) / (std(m, 2 * w) + TINY), "rsi": rsi(w), "stoch_k": k, "stoch_d": mean(k, 3), "williams_r": -100.0 * (high_of(H, w) - C) / (high_of(H, w) - low_of(L, w) + TINY)}
        return out | ({"macd": line, "macd_signal": ewm(line, 9), "macd_histogram": line - ewm(line, 9)} if w >= 12 else {})

    return _each(windows, one)


def volatility(windows) -> dict[str, Expr]:
    return _each(windows, lambda w: {
        "volatility": std(RET, w), "volatility_change": delta(std(RET, w)), "relative_volatility": std(RET, w) / (std(RET, 2 * w) + TINY), "atr": mean(TR, w), "bb_upper": mean(C, w) + 2.0 * std(C, w), "bb_lower": mean(C, w) - 2.0 * std(C, w),
        "bb_position": (C - mean(C, w)) / (2.0 * std(C, w) + TINY), "bb_width": 4.0 * std(C, w) / mean(C, w), "price_channel_position": place(w), "price_channel_width": (high_of(H, w) - low_of(L, w)) / C,
    })


def volume(windows) -> dict[str, Expr]:
    signed = (flag(MOVE > 0.0) - flag(MOVE < 0.0)) * V
    return _each(windows, lambda w: {
        "volume_ma": mean(V, w), "volume_ratio": V / (mean(V, w) + TINY), "volume_change": pct(V), "vwap": total(C * V, w) / total(V, w), "price_vwap_ratio": C / (total(C * V, w) / total(V, w) + TINY),
        "vpt": total(RET * V, w), "obv": total(signed, w), "volume_momentum": V / lag(V, w) - 1.0, "volume_volatility": std(pct(V), w),
    })


def pattern(windows) -> dict[str, Expr]:
    body, upper, lower = absolute(C - O), H - larger(C, O), smaller(C, O) - L
    return _each(windows, lambda w: {
        "hammer": flag((lower > 2.0 * body) & (upper < body)), "doji": flag(body < (H - L) * 0.1), "long_upper_shadow": flag(upper > 2.0 * body), "long_lower_shadow": flag(lower > 2.0 * body),
        "breakout_high": flag(C > lag(high_of(H, w))), "breakout_low": flag(C < lag(low_of(L, w))), "support_level": low_of(L, w), "resistance_level": high_of(H, w), "support_distance": (C - low_of(L, w)) / C,
        "resistance_distance": (high_of(H, w) - C) / C, "channel_breakout": larger(flag(C > lag(high_of(H, w))), flag(C < lag(low_of(L, w)))),
    })


def base(windows) -> dict[str, Expr]:
    return _each(windows, lambda w: {"momentum": C / lag(C, w) - 1.0, "price_position": place(w), "volatility": std(RET, w), "volume_ratio": V / mean(V, w), "price_volume_corr": corr(RET, pct(V), w)})


def interaction(windows) -> dict[str, Expr]:
    return _each(windows, lambda w: {
        "price_volume_interaction": C * V / mean(C, w), "vol_volume_interaction": std(RET, w) * V, "position_volume_interaction": place(w, C, C) * V, "momentum_volume_interaction": (C / lag(C, w) - 1.0) * V,
        "price_vol_interaction": C * std(RET, w), "returns_volume_interaction": RET * pct(V),
    })


def ratio(windows) -> dict[str, Expr]:
    return _each(windows, lambda w: {
        "high_low_ratio": H / (L + TINY), "close_open_ratio": C / (O + TINY), "volume_ma_ratio": V / (mean(V, w) + TINY), "momentum_ratio": (C / lag(C, w // 2) - 1.0) / (C / lag(C, w) - 1.0 + TINY),
        "volatility_ratio": std(RET, w // 2) / (std(RET, w) + TINY), "position_ratio": place(w // 2, C, C) / (place(w, C, C) + TINY),
    })


def candidates(windows) -> dict[str, Expr]:
    """Statistical candidates: momentum and its strength, returns' shape, place in the range, volume, RSI, bands, correlation, relative volatility."""

    def one(w: int) -> dict[str, Expr]:
        m, p = C / lag(C, w) - 1.0, (C - low_of(L, w)) / (high_of(H, w) - low_of(L, w))
        return {
            "momentum": m, "momentum_zscore": (m - mean(m, 2 * w)) / std(m, 2 * w), "momentum_strength": rank_of_last(m, w), "cum_returns": total(RET, w), "vol_adj_momentum": m / std(RET, w), "returns_skew": skew(RET, w), "returns_kurt": kurt(RET, w),
            "price_position": p, "price_position_change": delta(p), "volume_momentum": V / mean(V, w) - 1.0, "price_vwap_ratio": C / (total(C * V, w) / total(V, w)), "rsi": rsi(w, 0.0), "bb_position": (C - mean(C, w)) / (2.0 * std(C, w)),
            "price_volume_corr": corr(RET, pct(V), w), "price_autocorr": corr(RET, lag(RET), w - 1), "volatility": std(RET, w), "volatility_change": delta(std(RET, w)), "relative_volatility": std(RET, w) / std(RET, 2 * w),
        }

    return _each(windows, one)


def learning(windows=(5, 10, 20, 50)) -> dict[str, Expr]:
    """Inputs of a learner: returns, ratios, means, volatilities, momentum, RSI, bands, place in the range, and two interactions."""
    out = {"returns": RET, "log_returns": ln(C / lag(C)), "high_low_ratio": H / L, "close_open_ratio": C / O, "volume_ratio": V / mean(V, 20), "volume_change": pct(V)}
    out |= _each(windows, lambda w: {
        "sma": mean(C, w), "price_sma_ratio": C / mean(C, w), "volatility": std(RET, w), "momentum": C / lag(C, w) - 1.0, "rsi": rsi(w, 0.0), "bb_upper": mean(C, w) + 2.0 * std(C, w), "bb_lower": mean(C, w) - 2.0 * std(C, w),
        "bb_position": (C - mean(C, w)) / (2.0 * std(C, w)), "price_position": place(w, floor=0.0),
    })
    return out | {"price_volume_interaction": RET * pct(V), "volatility_volume_interaction": std(RET, 20) * V / mean(V, 20)}


def basic(windows=(5, 10, 20, 50)) -> dict[str, Expr]:
    """The standard feature table: returns, ratios to means, volatilities, RSI, places in the close's range, momentum."""
    out = {"returns": RET, "log_returns": ln(C / lag(C)), "high_low_ratio": H / (L + TINY), "close_open_ratio": C / (O + TINY), "volume_ratio": V / (mean(V, 20) + TINY), "volume_ma_5": mean(V, 5), "volume_ma_20": mean(V, 20)}
    out |= _each(windows, lambda w: {"ma": mean(C, w), "ma_ratio": C / (mean(C, w) + TINY), "volatility": std(RET, w)})
    return out | _each((5, 10, 20), lambda w: {"momentum": C / lag(C, w) - 1.0}) | _each((14, 21), lambda w: {"rsi": rsi(w)}) | _each((20, 50), lambda w: {"price_position": place(w, C, C)})


def targets(periods=(1, 5, 10, 20)) -> dict[str, Expr]:
    """The one-bar return, and the volatility of as many bars, that many bars later."""
    return _each(periods, lambda k: {"future_return": lead(RET, k), **({"future_volatility": lead(std(RET, k), k)} if k > 1 else {})})


def engineered(columns: dict[str, Expr], lags=(1, 2, 3, 5), windows=(5, 10, 20)) -> dict[str, Expr]:
    """Lags, differences and rolling shape of given features."""
    out = {f"{n}_lag_{k}": lag(e, k) for n, e in columns.items() for k in lags} | {f"{n}_diff": delta(e) for n, e in columns.items()}
    return out | {f"{n}_{kind}_{w}": build(e, w) for n, e in columns.items() for w in windows for kind, build in (("mean", mean), ("std", std), ("skew", skew), ("kurt", kurt))}


GENERATORS = {"trend": trend, "momentum": momentum, "volatility": volatility, "volume": volume, "pattern": pattern, "base": base, "interaction": interaction, "ratio": ratio, "candidates": candidates}
