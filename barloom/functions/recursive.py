"""Indicators whose value depends on their own last value: one ordered pass over each symbol's bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = ("kama", "parabolic_sar", "supertrend", "supertrend_direction", "market_structure")


def kama(close: np.ndarray, period: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive mean: speed follows the ratio of net to gross movement; starts at close[period]. A window without movement has no ratio, and no value follows it."""
    out = np.full(len(close), np.nan)
    if len(close) <= period:
        return out
    gross = pd.Series(np.abs(np.diff(close, prepend=np.nan))).rolling(period).sum().to_numpy()
    net = np.abs(close[period:] - close[:-period])
    ratio = np.full(len(close), np.nan)
    np.divide(net, gross[period:], out=ratio[period:], where=gross[period:] > 0)
    quick, lazy = 2.0 / (fast + 1), 2.0 / (slow + 1)
    speed = (ratio * (quick - lazy) + lazy) ** 2
    out[period] = close[period]
    for t in range(period + 1, len(close)):
        out[t] = out[t - 1] + speed[t] * (close[t] - out[t - 1])
    return out


def parabolic_sar(high: np.ndarray, low: np.ndarray, start=0.02, step=0.02, most=0.2) -> np.ndarray:
    """Stop-and-reverse: the stop closes in on the extreme point but stays outside the last two bars; a new extreme speeds it up
    before the bar is tested against it, and a touch flips the side and sets the stop to the extreme."""
    out = np.zeros(len(high))
    if not len(high):
        return out
    side, speed, extreme = 1, start, high[0]
    out[0] = low[0]
    for t in range(1, len(high)):
        near, far = (low, high) if side > 0 else (high, low)
        stop = out[t - 1] + speed * (extreme - out[t - 1])
        stop = side * min(side * stop, side * near[t - 1], side * near[t])
        if side * far[t] > side * extreme:
            extreme, speed = far[t], min(speed + step, most)
        if side * near[t] < side * stop:
            side, stop, extreme, speed = -side, extreme, near[t], start
        out[t] = stop
    return out


def supertrend(high, low, close, period: int = 10, factor: float = 3.0) -> np.ndarray:
    """Bands at a multiple of the mean true range around the midpoint, which only tighten until the close has crossed them.
    Starts on the upper band; changes band when the close is beyond the one it is on."""
    out = np.full(len(close), np.nan)
    prior = np.concatenate(([np.nan], close[:-1])) if len(close) else close
    true = np.fmax(high - low, np.fmax(np.abs(high - prior), np.abs(low - prior)))
    reach = factor * pd.Series(true).rolling(period).mean().to_numpy()
    middle, known = (high + low) / 2, np.flatnonzero(~np.isnan(reach))
    if not len(known):
        return out
    upper, lower = middle + reach, middle - reach
    out[known[0]] = upper[known[0]]
    for t in range(known[0] + 1, len(close)):
        if upper[t] >= upper[t - 1] and close[t - 1] <= upper[t - 1]:
            upper[t] = upper[t - 1]
        if lower[t] <= lower[t - 1] and close[t - 1] >= lower[t - 1]:
            lower[t] = lower[t - 1]
        on_upper = out[t - 1] == upper[t - 1]
        out[t] = upper[t] if (close[t] <= upper[t] if on_upper else close[t] < lower[t]) else lower[t]
    return out


def market_structure(high: pd.Series, low: pd.Series, lookback: int = 5) -> np.ndarray:
    """1 where the last swing high rises, less 1 where the last swing low falls. A swing high is the largest of the last ``lookback`` highs that end
    two rises, a swing low the smallest of the last lows that end two falls."""
    peaks = high[(high > high.shift(1)) & (high.shift(1) > high.shift(2))].rolling(lookback).max().ffill()
    troughs = low[(low < low.shift(1)) & (low.shift(1) < low.shift(2))].rolling(lookback).min().ffill()
    rising = (peaks > peaks.shift(1)).astype(int).reindex(high.index)
    falling = (troughs < troughs.shift(1)).astype(int).reindex(high.index)
    return (rising - falling).fillna(0.0).to_numpy(dtype=float)


def _pass(bars: pd.DataFrame) -> pd.DataFrame:
    bars = bars.sort_values("ts").reset_index(drop=True)
    h, low, c = (bars[x].to_numpy(dtype=float) for x in ("high", "low", "close"))
    trend = supertrend(h, low, c)
    out = bars[["symbol", "ts"]].assign(kama=kama(c), parabolic_sar=parabolic_sar(h, low), supertrend=trend, supertrend_direction=np.where(c >= trend, 1.0, -1.0), market_structure=market_structure(bars["high"], bars["low"]))
    return out.round(6)


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """symbol, ts and the recursive indicators. A task holds one symbol's bars."""
    rows = bars.selectExpr("CAST(symbol AS STRING) AS symbol", "CAST(ts AS STRING) AS ts", "high", "low", "close")
    return rows.groupBy("symbol").applyInPandas(_pass, "symbol string, ts string, " + ", ".join(f"{c} double" for c in COLUMNS))
