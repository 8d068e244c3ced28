"""Rolling information coefficients of factors, and weights for every date from sums over their past.

Everything a date needs are sums of ICs, of their products and of their sizes over a run of rows, so one sort of a symbol's rows serves all dates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import unit_l1


def rolling_ic_matrix(rows: DataFrame, names: list[str], ret: str = "ret", window: int = 60, least: int = 20, key: str = "symbol", order: str = "ts") -> DataFrame:
    """rows(key, order, names..., ret) -> (key, order, names...): each factor's correlation with the return over the last ``window`` rows.

    Rows need a return and half of the factors (one at least); the first ``least`` - 1 rows of a key give none, keys with fewer than the larger of window
    and ``least`` rows none at all. A correlation takes the rows that have the factor. Rows without any correlation are left out; what is
    missing in others becomes the factor's median of the key, or 0 without one.
    """
    window, least = max(window, 5), max(least, 5)
    some = sum((F.col(f"`{n}`").isNotNull().cast("int") for n in names), F.lit(0)) >= max(1, len(names) // 2)
    aligned = rows.filter(F.col(ret).isNotNull() & some)
    by = Window.partitionBy(key).orderBy(order)
    run = by.rowsBetween(-(window - 1), Window.currentRow)

    def correlation(n: str):
        x, y = F.col(f"`{n}`").cast("double"), F.when(F.col(f"`{n}`").isNotNull(), F.col(ret).cast("double"))
        spread = F.stddev_samp(x).over(run) * F.stddev_samp(y).over(run)
        return F.when(spread > 1e-14, F.covar_samp(x, y).over(run) / spread).alias(n)

    known = aligned.select(key, order, *[correlation(n) for n in names], F.row_number().over(by).alias("__rn"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("__rows"))
    known = known.filter((F.col("__rn") >= least) & (F.col("__rows") >= max(window, least))).filter(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull()).drop("__rn", "__rows")
    middle = known.groupBy(key).agg(*[F.expr(f"percentile(`{n}`, 0.5)").alias(f"__m{i}") for i, n in enumerate(names)])
    return known.join(middle, key).select(key, order, *[F.coalesce(F.col(f"`{n}`"), f"__m{i}", F.lit(0.0)).alias(n) for i, n in enumerate(names)])


class ICSums:
    """Sums over runs of rows of k numbers x: x, products x_i x_j, x |x|^2 and |x|^4; a run a row. Mean, covariance and its Ledoit-Wolf share follow."""

    def __init__(self, sums: np.ndarray, n: np.ndarray, k: int):
        i, j = np.triu_indices(k)
        self.n, self.k, self.first, self.times, self.squared = n, k, sums[:, :k], sums[:, -k - 1 : -1], sums[:, -1]
        self.mean = self.first / np.maximum(n, 1)[:, None]
        self.second = np.zeros((len(n), k, k))
        self.second[:, i, j] = self.second[:, j, i] = sums[:, k : k + len(i)]

    @staticmethod
    def terms(x: list[Column]) -> list[Column]:
        """What to sum up of each row, in the order taken here."""
        k, size = len(x), sum((c * c for c in x), F.lit(0.0))
        return [*x, *[x[i] * x[j] for i in range(k) for j in range(i, k)], *[c * size for c in x], size * size]

    def covariance(self) -> np.ndarray:
        return self.second / np.maximum(self.n, 1)[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]

    def shrunk(self) -> np.ndarray:
        """Covariance towards the mean variance times the identity, by the estimated share of its error."""
        n, mean, cov = np.maximum(self.n, 1), self.mean, self.covariance()
        total, m = np.trace(self.second, axis1=1, axis2=2), (mean * mean).sum(axis=1)
        along = np.einsum("ti,tij,tj->t", mean, self.second, mean)
        # the sum of |x - mean|^4, multiplied out
        fourth = self.squared + 4 * along + n * m * m - 4 * (mean * self.times).sum(axis=1) + 2 * m * total - 4 * m * m * n
        level, eye = np.trace(cov, axis1=1, axis2=2) / self.k, np.eye(self.k)
        apart = ((cov - level[:, None, None] * eye) ** 2).sum(axis=(1, 2)) / self.k
        error = (fourth / n - (cov**2).sum(axis=(1, 2))) / (self.k * n)
        share = np.where(apart > 0, np.minimum(np.maximum(error, 0.0), apart) / np.maximum(apart, 1e-300), 0.0)
        return (1 - share)[:, None, None] * cov + (share * level)[:, None, None] * eye


def icir_weights(ic: DataFrame, names: list[str], history: int | None = None, ridge: float = 1e-6, positive: bool = False, key: str = "symbol", order: str = "ts") -> DataFrame:
    """(key, order, n, names...): weights that sum to 1 in absolute value, in proportion to the inverse shrunk covariance times the mean of the ICs of the last
    ``history`` rows (all so far, if None). Equal weights from one row alone. A batch of rows is solved at once.
    """
    k = len(names)
    terms = ICSums.terms([F.col(f"`{n}`") for n in names])
    width = len(terms)
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding if history is None else -(history - 1), Window.currentRow)
    sums = ic.select(key, order, F.count(F.lit(1)).over(run).cast("double").alias("n"), F.array(*[F.sum(t).over(run) for t in terms]).alias("sums"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            found = ICSums(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(n), width), n, k)
            w = np.linalg.solve(found.shrunk() + ridge * np.eye(k), found.mean[:, :, None])[:, :, 0]
            w = np.stack([unit_l1(row, positive) if size > 1 else np.full(k, 1.0 / k) for row, size in zip(w, n, strict=True)]) if len(n) else w
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), *[pa.array(w[:, i]) for i in range(k)]], [key, order, "n", *names])

    kinds = ", ".join(f"`{c}` {ic.schema[c].dataType.simpleString()}" for c in (key, order))
    return sums.mapInArrow(solved, f"{kinds}, n bigint, " + ", ".join(f"`{n}` double" for n in names))


def weighted_factor(rows: DataFrame, weights: DataFrame, names: list[str], key: str = "symbol", order: str = "ts") -> DataFrame:
    """(key, order, factor): each row's factors times the latest weights up to it; missing factors count as 0, rows before the first weights have none."""
    both = rows.select(key, order, *[F.col(f"`{n}`").cast("double").alias(n) for n in names]).join(weights.select(key, order, F.struct(*[F.col(f"`{n}`") for n in names]).alias("__w")), [key, order], "left")
    latest = F.last("__w", True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = both.withColumn("__w", latest).filter("__w is not null")
    return carried.select(key, order, sum((F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) * F.col("__w")[n] for n in names), F.lit(0.0)).alias("factor"))
