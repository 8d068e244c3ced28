"""Moments that tasks add up group by group, and principal components from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of which a task holds moments before it hands them on.
HELD = 4096


class Moments:
    """Rows, means and centred cross products of columns; two of them add up without cancellation, however large the means."""

    __slots__ = ("n", "mean", "cross")

    def __init__(self, n: float, mean: np.ndarray, cross: np.ndarray):
        self.n, self.mean, self.cross = n, mean, cross

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        return cls(len(x), mean, (x - mean).T @ (x - mean))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))


def _fields(rows: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)


def group_moments(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., n, mean array, cross array of k * k): moments of each group over all its rows, missing values as 0.

    A task adds up its own rows first, so a group costs k * k numbers a task, and a group of any size is no task's alone.
    """
    k = len(columns)
    kind = ", ".join([*([_fields(rows, by)] if by else []), "n double", "mean array<double>", "cross array<double>"])

    def packed(held: dict[tuple, Moments], types: list) -> pa.RecordBatch:
        keys = list(zip(*held, strict=True)) if by else []
        values = [pa.array([m.n for m in held.values()], pa.float64()), *[pa.array([getattr(m, c).ravel() for m in held.values()], pa.list_(pa.float64())) for c in ("mean", "cross")]]
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(keys, types, strict=True)], *values], [*by, "n", "mean", "cross"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        types: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(c).type for c in by]
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[-k:]], axis=1)
            x = np.where(np.isfinite(x), x, 0.0)
            if by:
                codes, keys = pd.factorize(pd.MultiIndex.from_arrays([batch.column(c).to_pandas() for c in by]))
                order = np.argsort(codes, kind="stable")
                edge = np.flatnonzero(np.diff(codes[order], prepend=-1))
                parts = [(tuple(batch.column(c)[int(rows_[0])].as_py() for c in by), x[rows_]) for rows_ in np.split(order, edge[1:])]
            else:
                parts = [((), x)]
            for key, some in parts:
                held[key] = held[key] + Moments.of(some) if key in held else Moments.of(some)
            if len(held) > HELD:
                yield packed(held, types)
                held = {}
        if held:
            yield packed(held, types)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        total = None
        for n, mean, cross in sorted(zip(table["n"].to_pylist(), table["mean"].to_pylist(), table["cross"].to_pylist(), strict=True)):
            one = Moments(n, np.array(mean), np.array(cross).reshape(k, k))
            total = one if total is None else total + one
        types = [table.schema.field(c).type for c in by]
        batch = packed({tuple(v.as_py() for v in key) if by else (): total}, types)
        return pa.Table.from_batches([batch])

    some = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, kind)
    return some.groupBy(*by).applyInArrow(merged, kind)


def principal_axes(moments: DataFrame, by: list[str], names: list[str], most: int) -> DataFrame:
    """(by..., component, variance, share, weights, shift): axes of the columns divided by their deviation, by falling variance. A row's score is the sum of
    weights times columns, minus shift. The largest weight of an axis is positive; constant columns have weight 0. Groups of one row have no axes."""
    k = len(names)

    def axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(by) + 5)]
            for row in range(batch.num_rows):
                n, mean, cross = (np.array(batch.column(c)[row].as_py()) for c in ("n", "mean", "cross"))
                if n < 2:
                    continue
                cross = cross.reshape(k, k)
                scale = np.sqrt(np.diag(cross) / n)
                inverse = np.where(scale > 1e-12 * np.maximum(1.0, np.abs(mean)), 1.0 / np.maximum(scale, 1e-300), 0.0)
                values, vectors = np.linalg.eigh(cross * inverse[:, None] * inverse[None, :] / (n - 1))
                order = np.argsort(-values, kind="stable")[:most]
                for c, i in enumerate(order):
                    v = vectors[:, i] * (1.0 if vectors[np.abs(vectors[:, i]).argmax(), i] > 0 else -1.0)
                    cells = [*[batch.column(b)[row].as_py() for b in by], c + 1, float(max(values[i], 0.0)), float(max(values[i], 0.0) / max(values.sum(), 1e-300)), (v * inverse).tolist(), float((v * inverse) @ mean)]
                    for column, value in zip(out, cells, strict=True):
                        column.append(value)
            types = [*[batch.column(b).type for b in by], pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [*by, "component", "variance", "share", "weights", "shift"])

    head = f"{_fields(moments, by)}, " if by else ""
    return moments.mapInArrow(axes, f"{head}component int, variance double, share double, weights array<double>, shift double")


def principal_components(rows: DataFrame, by: list[str], columns: list[str], most: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """((by..., keep..., pca_component_1...), axes): each row's scores on its group's principal axes; missing values count as 0, as in the axes."""
    axes = principal_axes(group_moments(rows, by, columns), by, columns, most)
    packed = axes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("component", "weights", "shift"))).alias("__axes"))
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])
    joined = rows.join(packed, by) if by else rows.crossJoin(F.broadcast(packed))  # one row

    def score(i: int):
        axis = F.get("__axes", F.lit(i))
        return (F.aggregate(F.zip_with(axis["weights"], "__x", lambda w, v: w * v), F.lit(0.0), lambda a, b: a + b) - axis["shift"]).alias(f"pca_component_{i + 1}")

    return joined.withColumn("__x", x).select(*by, *keep, *[score(i) for i in range(min(most, len(columns)))]), axes
