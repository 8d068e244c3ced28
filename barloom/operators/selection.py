"""Choosing and weighting factors. Correlations and moments come from Spark; what is left is k by k for k factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.tables import cut_lineage


def daily_rank_ic(long: DataFrame) -> DataFrame:
    """long(symbol, ts, name, value, ret) -> (ts, name, ic): Spearman IC with average ranks, date by date and factor by factor."""
    from pyspark.sql import Window

    def ranked(c: str):
        up_to = Window.partitionBy("ts", "name").orderBy(c)  # one sort: the count takes all rows up to the value, its equals included
        return (F.rank().over(up_to) + F.count(F.lit(1)).over(up_to)) / 2

    k = long.select("ts", "name", ranked("value").alias("a"), ranked("ret").alias("b"))
    spread = F.stddev_samp("a") * F.stddev_samp("b")
    return k.groupBy("ts", "name").agg(F.when(spread > 1e-12, F.covar_samp("a", "b") / spread).alias("ic")).filter("ic is not null")


def wide(long: DataFrame, key: str | list[str], names: list[str], value: str) -> DataFrame:
    """A column for each name (of the first value by the key), numbered c0, c1, ..."""
    keys = [key] if isinstance(key, str) else key
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(f"c{i}") for i, n in enumerate(names)])


def pair_moments(table: DataFrame, k: int) -> DataFrame:
    """table(c0..c{k-1}) -> (a, b, n, sx, sy, sxx, syy, sxy) for a < b over the rows that have both. Tasks add up k by k matrices of their rows, so what is
    shuffled is k * k numbers a task, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1).reshape(-1, k)
            on = np.isfinite(x)
            x, on = np.where(on, x, 0.0), on.astype(float)
            total += np.stack([on.T @ on, x.T @ on, on.T @ x, (x * x).T @ on, on.T @ (x * x), x.T @ x])
        a, b = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *[pa.array(m[a, b]) for m in total]], ["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = table.select(*[F.col(f"c{i}").cast("double").alias(f"c{i}") for i in range(k)]).mapInArrow(run, "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlations(table: DataFrame, names: list[str], least: int = 2) -> DataFrame:
    """(a, b, n, correlation) of the named columns of ``wide``, each pair over the rows that have both; null without variance."""
    m = pair_moments(table, len(names)).filter(F.col("n") >= least)
    spread = F.sqrt(F.greatest((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")), F.lit(0.0)))
    called = F.array(*map(F.lit, names))
    r = F.when(spread > 1e-12, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / spread)
    return m.select(F.element_at(called, F.col("a") + 1).alias("a"), F.element_at(called, F.col("b") + 1).alias("b"), F.col("n").cast("long").alias("n"), r.alias("correlation"))


def moments(ic: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, int, float]:
    """Names, means of the known ICs, covariance (population) with unknown ICs as 0, dates, and the mean fourth moment sum that Ledoit-Wolf shrinkage needs.
    ``ic`` is read several times, so it is computed once and kept: a row for each date and factor."""
    ic = cut_lineage(ic)
    names = [r["name"] for r in ic.select("name").distinct().orderBy("name").collect()]
    k = len(names)
    table = wide(ic, "ts", names, "ic")
    filled = table.select("ts", *[F.coalesce(f"c{i}", F.lit(0.0)).alias(f"c{i}") for i in range(k)])
    zero_of = [F.coalesce(f"c{i}", F.lit(0.0)) for i in range(k)]
    columns = [[F.avg(f"c{i}").alias(f"m{i}"), F.avg(zero_of[i]).alias(f"z{i}"), F.var_pop(zero_of[i]).alias(f"v{i}")] for i in range(k)]
    row = table.agg(F.count(F.lit(1)).alias("n"), *[c for some in columns for c in some]).head()
    n, zero = row["n"], [row[f"z{i}"] or 0.0 for i in range(k)]
    cov = np.diag([row[f"v{i}"] or 0.0 for i in range(k)])
    for r in pair_moments(filled, k).collect():  # k * k rows
        cov[r["a"], r["b"]] = cov[r["b"], r["a"]] = r["sxy"] / n - zero[r["a"]] * zero[r["b"]]
    size = sum(((F.col(f"c{i}") - zero[i]) * (F.col(f"c{i}") - zero[i]) for i in range(k)), F.lit(0.0))
    fourth = filled.agg(F.avg(size * size)).head()[0] or 0.0
    return names, np.array([row[f"m{i}"] or 0.0 for i in range(k)]), cov, n, fourth


def shrink(cov: np.ndarray, n: int, fourth: float) -> np.ndarray:
    """Ledoit-Wolf: towards the mean variance times the identity, by the estimated share of the covariance's error.

    ``fourth`` is the mean over observations of the squared sum of squared deviations.
    """
    k = len(cov)
    level = np.trace(cov) / max(1, k)
    apart = ((cov - level * np.eye(k)) ** 2).sum() / max(1, k)
    error = (fourth - (cov**2).sum()) / (max(1, k) * max(1, n))
    weight = min(max(error, 0.0), apart) / apart if apart > 0 else 0.0
    return (1 - weight) * cov + weight * level * np.eye(k)


def unit_l1(w: np.ndarray, positive: bool = False) -> np.ndarray:
    w = np.maximum(w, 0.0) if positive else w
    size = np.abs(w).sum()
    return w / size if size > 0 else np.full(len(w), 1.0 / max(1, len(w)))


def weights(ic: DataFrame, method: str = "max_icir", ridge: float = 1e-6) -> dict[str, float]:
    """Factor weights that sum to 1 in absolute value: equal, mean_ic, or max_icir (inverse shrunk covariance times mean). With fewer than five dates, or fewer than factors, equal."""
    return all_weights(ic, (method,), ridge)[method]


def all_weights(ic: DataFrame, methods: tuple[str, ...], ridge: float = 1e-6) -> dict[str, dict[str, float]]:
    """``weights`` by several methods, from ICs and moments that are worked out once."""
    names, mean, cov, n, fourth = moments(ic)
    out = {}
    for method in methods:
        if method == "equal" or n < max(5, len(names)):
            w = np.ones(len(names))
        elif method == "mean_ic":
            w = mean
        else:
            w = np.linalg.lstsq((shrink(cov, n, fourth) if n > len(names) else cov * n / (n - 1)) + ridge * np.eye(len(names)), mean, rcond=None)[0]
        out[method] = dict(zip(names, unit_l1(w).tolist(), strict=True))
    return out


def greedy(scores: dict[str, float], correlation: dict[tuple[str, str], float], most: int, limit: float) -> list[str]:
    """By falling score, each factor whose correlation with all chosen ones stays within the limit."""
    chosen: list[str] = []
    for name in sorted(scores, key=lambda x: (-abs(scores[x]), x)):
        if len(chosen) < most and all(abs(correlation.get((min(a, name), max(a, name)), 0.0)) <= limit for a in chosen):
            chosen.append(name)
    return chosen


def ensemble(long: DataFrame, weight: dict[str, float]) -> DataFrame:
    """Weighted mean of the factors known on each row: symbol, ts, factor."""
    w = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])[F.col("name")]
    return long.groupBy("symbol", "ts").agg((F.sum(F.col("value") * w) / F.nullif(F.sum(F.abs(w)), F.lit(0))).alias("factor"))


def rank_agreement(long: DataFrame) -> DataFrame:
    """long(symbol, ts, name, value) -> (a, b, dates, spearman, same_rank): means over dates of the Spearman correlation and of the share of equal average
    ranks, over the symbols that have both factors. A task holds one date: its symbols by factors."""

    def day(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="symbol", columns="name", values="value", aggfunc="max")
        out = []
        for i, a in enumerate(table.columns):
            for b in table.columns[i + 1 :]:
                both = table[[a, b]].dropna().rank()
                x, y = both[a].to_numpy(), both[b].to_numpy()
                spread = x.std() * y.std() if len(x) > 1 else 0.0
                if spread > 1e-12:
                    out.append((a, b, float(((x - x.mean()) * (y - y.mean())).mean() / spread), float((x == y).mean())))
        return pd.DataFrame(out, columns=["a", "b", "r", "same"])

    days = long.select("ts", "symbol", "name", "value").groupBy("ts").applyInPandas(day, "a string, b string, r double, same double")
    return days.groupBy("a", "b").agg(F.count(F.lit(1)).alias("dates"), F.avg("r").alias("spearman"), F.avg("same").alias("same_rank"))


def duplicate_groups(pairs: list[tuple[str, str, int, float, float]], spearman: float = 0.999, same: float = 0.99, dates: int = 10) -> list[list[str]]:
    """Factors that agree by ``rank_agreement``, as sorted groups; k factors give at most k * k / 2 pairs."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b, n, r, s in pairs:
        if n >= dates and r > spearman and s > same:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    groups: dict[str, list[str]] = {}
    for x in sorted(parent):
        groups.setdefault(root(x), []).append(x)
    return sorted(g for g in groups.values() if len(g) > 1)
