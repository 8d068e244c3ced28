"""Strict replay of a coarse factor inside its bar: at every base bar the factor sees the completed coarse bars and the running one, and nothing later."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_VALUES = ("open", "high", "low", "close", "volume")
#: Base bars that are laid out as one matrix.
_ROWS = 512

#: Takes the columns open to volume, each a matrix with a row for each base bar, its last column the running bar and those before it the completed ones;
#: returns a value a row.
Factor = Callable[[dict[str, np.ndarray]], np.ndarray]


def momentum(bars: int) -> Factor:
    """Change of the close against the close so many bars before."""

    def value(seen: dict[str, np.ndarray]) -> np.ndarray:
        close = seen["close"]
        return close[:, -1] / close[:, -1 - bars] - 1 if close.shape[1] > bars else np.full(len(close), np.nan)

    return value


def zscore(bars: int) -> Factor:
    """Distance of the close from the mean of the last closes, in sample deviations; null where these are flat."""

    def value(seen: dict[str, np.ndarray]) -> np.ndarray:
        last = seen["close"][:, -bars:]
        if last.shape[1] < bars:
            return np.full(len(last), np.nan)
        spread = last.std(axis=1, ddof=1)
        return np.where(spread > 1e-12, (last[:, -1] - last.mean(axis=1)) / np.where(spread > 1e-12, spread, 1), np.nan)

    return value


def range_place() -> Factor:
    """Place of the close between the lowest low (0) and the highest high (1) of all bars seen."""

    def value(seen: dict[str, np.ndarray]) -> np.ndarray:
        low, high = seen["low"].min(axis=1), seen["high"].max(axis=1)
        return np.where(high > low, (seen["close"][:, -1] - low) / np.where(high > low, high - low, 1), np.nan)

    return value


def _replayed(factors: dict[str, Factor], lookback: int):
    def run(done: pd.DataFrame, running: pd.DataFrame) -> pd.DataFrame:
        if not len(running):
            return running[["symbol", "ts"]].assign(**{n: np.empty(0) for n in factors})
        done, running = done.sort_values("n"), running.sort_values("seen", kind="stable").reset_index(drop=True)
        number, past = done["n"].to_numpy(), {c: done[c].to_numpy(float) for c in _VALUES}
        seen, now = running["seen"].to_numpy(), {c: running[c].to_numpy(float) for c in _VALUES}
        out = {n: np.full(len(running), np.nan) for n in factors}
        edges = np.flatnonzero(np.diff(seen, prepend=seen[0] - 1))
        for start, stop in zip(edges, [*edges[1:], len(seen)]):
            lo, hi = np.searchsorted(number, [seen[start] - lookback, seen[start]])
            for at in range(start, stop, _ROWS):
                end = min(at + _ROWS, stop)
                laid = {c: np.hstack([np.broadcast_to(past[c][lo:hi], (end - at, hi - lo)), now[c][at:end, None]]) for c in _VALUES}
                for name, factor in factors.items():
                    out[name][at:end] = factor(laid)
        return pd.DataFrame({"symbol": running["symbol"], "ts": running["ts"], **{n: pd.Series(v).where(np.isfinite(v)) for n, v in out.items()}})

    return run


def replay(bars: DataFrame, factors: dict[str, Factor], secs: int, lookback: int = 200, block: int = 2048) -> DataFrame:
    """bars(symbol, ts, open, high, low, close, volume) -> symbol, ts and a column a factor, a row for each base bar.

    Coarse bars last ``secs`` seconds and start at whole multiples of them. A completed bar covers (start, end] and is known from its end on; the running bar
    starts with the base bar at its start. A factor sees at most ``lookback`` completed bars, fewer where there are no more, and the running bar.

    Coarse bars are counted for each symbol once they are aggregated; base bars never are ordered by symbol. Blocks of ``block`` coarse bars are replayed
    apart, each with the ``lookback`` bars before it, so a symbol of any length is spread over tasks, and a task's state is one block.

    Rows with a null symbol or time take no part; other nulls are passed over as in a running maximum, a null close gives null. Several bars of one
    symbol and time give a row each, taken in the order of their values. What is not a finite number is null. Other columns are left out.
    """
    if lookback < 1 or block < 1:
        raise ValueError("lookback and block must be positive")
    unit = secs * 1_000_000
    kind = bars.schema["symbol"].dataType
    base = bars.filter("symbol is not null and ts is not null").select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in _VALUES])
    base = base.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("starts", F.expr(f"at - pmod(at, {unit}L)"))

    def edge(pick, column):
        return pick(F.when(F.col(column).isNotNull(), F.struct("at", column)))[column].alias(column)

    done = base.groupBy("symbol", F.expr(f"at + pmod(-at, {unit}L)").alias("ends")).agg(edge(F.min, "open"), F.max("high").alias("high"), F.min("low").alias("low"), edge(F.max, "close"), F.sum("volume").alias("volume"))
    done = done.withColumn("n", (F.row_number().over(Window.partitionBy("symbol").orderBy("ends")) - 1).cast("bigint"))
    starts = base.select("symbol", "starts").distinct()
    marks = starts.select("symbol", F.col("starts").alias("mark"), F.lit(1).alias("side")).unionByName(done.select("symbol", F.col("ends").alias("mark"), F.lit(0).alias("side")))
    upto = Window.partitionBy("symbol").orderBy("mark", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("seen", F.sum(1 - F.col("side")).over(upto)).filter("side = 1").select("symbol", F.col("mark").alias("starts"), "seen")

    order = Window.partitionBy("symbol", "starts").orderBy("at", *_VALUES).rowsBetween(Window.unboundedPreceding, 0)
    running = base.select("symbol", "ts", "starts", F.first("open", ignorenulls=True).over(order).alias("open"), F.max("high").over(order).alias("high"), F.min("low").over(order).alias("low"), "close", F.sum("volume").over(order).alias("volume"))
    running = running.join(seen, ["symbol", "starts"]).withColumn("block", F.expr(f"seen div {block}"))
    spread = done.withColumn("block", F.explode(F.sequence(F.expr(f"(n + 1) div {block}"), F.expr(f"(n + {lookback}) div {block}")))).drop("ends")
    spread = spread.select(*[F.col(c).alias(c) for c in ("symbol", "block", "n", *_VALUES)])  # columns of its own beside those of the running bars
    schema = f"symbol {kind.simpleString()}, ts {bars.schema['ts'].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in factors)
    return spread.groupBy("symbol", "block").cogroup(running.drop("starts").groupBy("symbol", "block")).applyInPandas(_replayed(factors, lookback), schema)
