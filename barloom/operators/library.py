"""The library of factor definitions as a table: definitions(name, family, lookahead, text)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of column names that tell of the target or of what was made from it. Such columns are no features.
TARGET_WORDS = ("future", "fwd", "forward", "next_", "target", "label", "return_t+", "pnl", "profit", "sharpe", "signal", "predict", "pred_", "forecast")


def definitions(spark: SparkSession, rows: list[tuple[str, str, bool, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, family string, lookahead boolean, text string")


def search(library: DataFrame, words: str = "", family: str | None = None, lookahead: bool | None = None) -> DataFrame:
    """Definitions whose name or text contains the words, of a family and of a kind."""
    out = library.filter(F.lower("name").contains(words.lower()) | F.lower("text").contains(words.lower())) if words else library
    out = out.filter(F.col("family") == family) if family else out
    return out if lookahead is None else out.filter(F.col("lookahead") == lookahead)


def stats(library: DataFrame) -> DataFrame:
    """Definitions of each family, those that look ahead, and the mean length of their text."""
    return library.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if("lookahead").alias("lookahead"), F.avg(F.length("text")).alias("mean_length"))


def diff(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(name, state): identical, different, new (in ``theirs`` alone) or missing, by the digest of the text."""
    a, b = (df.select("name", F.md5("text").alias(side)) for df, side in ((mine, "a"), (theirs, "b")))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "identical").otherwise("different")
    return a.join(b, "name", "outer").select("name", state.alias("state"))


def health(library: DataFrame, stored: DataFrame) -> DataFrame:
    """Names without a stored series (missing) and stored series without a definition (orphan): stored(name)."""
    names = stored.select("name").distinct()
    missing = library.select("name").join(names, "name", "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(names.join(library.select("name"), "name", "left_anti").withColumn("state", F.lit("orphan")))


def features_only(columns: list[str]) -> list[str]:
    """Columns whose names do not tell of the target: none of TARGET_WORDS, not y or y_..., nor this library's own return columns."""
    low = {c: c.lower() for c in columns}
    return [c for c in columns if not any(w in low[c] for w in TARGET_WORDS) and not low[c].startswith("y_") and low[c] not in ("y", "ret", "returns_next")]


def seconds_of(timeframe: str) -> int:
    """'15m', '4h', '1d', '2w' -> seconds; ValueError otherwise."""
    found = re.fullmatch(r"(\d+)([mhdw])", timeframe)
    if not found:
        raise ValueError(f"no timeframe: {timeframe!r}")
    return int(found[1]) * {"m": 60, "h": 3600, "d": 86400, "w": 604800}[found[2]]


def signal_lag(metadata: dict | None = None, params: dict | None = None, default: int = 1, computation: dict | None = None) -> int:
    """Bars between a value and the trade on it: the first of lag, signal_lag, trade_lag and shift that metadata, parameters or computation data hold (the names in this
    order, each looked up in this order), else the default. The first of lookahead and future_bars found so is added. What is no whole number gives the default; never below 0."""
    places = [metadata or {}, params or {}, computation or {}]
    given = next((d[k] for k in ("lag", "signal_lag", "trade_lag", "shift") for d in places if d.get(k) is not None), default)
    ahead = next((d[k] for k in ("lookahead", "future_bars") for d in places if d.get(k) is not None), 0)
    try:
        return max(0, int(given) + int(ahead or 0))
    except (TypeError, ValueError):
        return default


def split_ratios(train: float, test: float, validation: float = 0.0) -> tuple[float, float, float]:
    """Non-negative shares that add up to 1; 0.8, 0.2 and 0 where all are 0."""
    shares = [max(0.0, x) for x in (train, test, validation)]
    return tuple(x / sum(shares) for x in shares) if sum(shares) else (0.8, 0.2, 0.0)
