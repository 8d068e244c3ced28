"""Association of two columns by ranks: Kendall's tau-b of any number of groups without joining a pair of rows.

Rows with equal values are one row with a weight. Pairs that disagree are inversions: rows are dealt to ranges of (group, x, y), inversions inside a range come from a
merge, those between ranges from ranges of (group, y) over the rows' range numbers, and those between both kinds of ranges from their
table of counts. A group of any size spreads over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.tables import cut_lineage


def inversions(y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w[i] * w[j] over i < j with y[i] > y[j], by the levels of a merge sort."""
    n, total, half = len(y), 0, 1
    at = np.arange(n)
    while half < n:
        block, right = at // (2 * half), at // half % 2
        order = np.lexsort((right, y, block))  # of equal values the left ones first, so they are not above
        left_weight = np.where(right[order] == 0, w[order], 0)
        upto = np.cumsum(left_weight)
        last = np.searchsorted(block[order], block[order], "right") - 1
        above = upto[last] - upto
        total += int((above * np.where(right[order] == 1, w[order], 0)).sum())
        half *= 2
    return total


def _counted(groups: int):
    """Rows (group columns..., piece, y, w) in order -> (group columns..., piece, inverted): inversions inside each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, names, held = None, [], []

        def out() -> pa.RecordBatch:
            y, w = (np.concatenate(c) for c in zip(*held, strict=True))
            columns = [*[pa.array([v], t) for v, t in zip(here, kinds, strict=True)], pa.array([inversions(y, w)], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [*names, "inverted"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, kinds = batch.schema.names[: groups + 1], batch.schema.types[: groups + 1]
            keys = pd.DataFrame({str(i): batch.column(i).to_pandas() for i in range(groups + 1)})
            edge = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            y, w = batch.column(groups + 1).to_numpy(), batch.column(groups + 2).to_numpy()
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows], strict=True):
                key = tuple(batch.column(i)[a].as_py() for i in range(groups + 1))
                if key != here and held:
                    yield out()
                    held = []
                here = key
                held.append((y[a:b], w[a:b]))
        if held:
            yield out()

    return run


def _between(pdf: pd.DataFrame) -> float:
    """Inversions between cells of the table of (piece, part) counts: sum of n[p, q] * n[p2, q2] over p < p2, q > q2."""
    table = pdf.pivot_table(index="piece", columns="part", values="n", aggfunc="sum", fill_value=0).sort_index().sort_index(axis=1).to_numpy().astype(object)
    below = np.cumsum(np.cumsum(table[::-1], axis=0)[::-1], axis=1)  # pieces from p on, parts up to q
    return int((table[:-1, 1:] * below[1:, :-1]).sum()) if min(table.shape) > 1 else 0


def _ranged(rows: DataFrame, by: list[str], order: list[str], name: str, parts: int | None) -> DataFrame:
    """Rows in ranges of ``by`` and ``order``, each with its range's number: stored, as ranges may fall differently when computed again."""
    spread = rows.repartitionByRange(*([parts] if parts else []), *by, *order)
    return cut_lineage(spread.withColumn(name, F.spark_partition_id()).sortWithinPartitions(*by, name, *order))


def _inside(rows: DataFrame, by: list[str], piece: str, y: str) -> DataFrame:
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.select(*by, F.col(piece).alias("piece"), y, "w").mapInArrow(_counted(len(by)), f"{fields}, piece int, inverted bigint").groupBy(*by).agg(F.sum("inverted").alias("inverted"))


def kendall(rows: DataFrame, by: list[str], x: str, y: str, least: int = 10, parts: int | None = None) -> DataFrame:
    """(by..., n, kendall): tau-b over the rows of each group that have both values; null with fewer than ``least`` rows or without spread.

    ``parts`` is the number of ranges (by default the session's number of shuffle partitions). NaN counts as missing.
    """
    known = rows.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    cells = cut_lineage(known.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("w")))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    ties_x = cells.groupBy(*by, "x").agg(F.sum("w").alias("t")).groupBy(*by).agg(F.sum("t").alias("n"), pairs("t").alias("n1"))
    ties_y = cells.groupBy(*by, "y").agg(F.sum("w").alias("t")).groupBy(*by).agg(pairs("t").alias("n2"))
    ties = cells.groupBy(*by).agg(pairs("w").alias("n3"))
    pieces = _ranged(cells, by, ["x", "y"], "piece", parts)
    found = _inside(pieces, by, "piece", "y")
    split = pieces.groupBy(*by).agg(F.countDistinct("piece").alias("pieces")).filter("pieces > 1").select(*by)
    wide = pieces.join(split, by, "left_semi").groupBy(*by, "piece", "y").agg(F.sum("w").alias("w"))
    # ranges of y; inside one, rows by piece
    spread = wide.repartitionByRange(*([parts] if parts else []), *by, "y").withColumn("part", F.spark_partition_id()).sortWithinPartitions(*by, "part", "piece", "y")
    spread = cut_lineage(spread)
    found = found.unionByName(_inside(spread, by, "part", "y"))
    counts = spread.groupBy(*by, "piece", "part").agg(F.sum("w").alias("n"))
    fields = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by)
    cross = counts.groupBy(*by).applyInPandas(lambda key, pdf: pd.DataFrame([[*key, _between(pdf)]], columns=[*by, "inverted"]), f"{fields}, inverted bigint")
    wrong = found.unionByName(cross).groupBy(*by).agg(F.sum("inverted").alias("wrong"))
    joined = ties_x.join(ties_y, by).join(ties, by).join(wrong, by)
    n0 = F.col("n") * (F.col("n") - 1) / 2
    spread_of = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    tau = (n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("wrong")) / spread_of
    return joined.select(*by, "n", F.when((F.col("n") >= least) & (spread_of > 0), tau).alias("kendall"))


# ---- scores of features against a target -------------------------------------------------

#: Scaled values are rounded to this part of a standard deviation, so that equal distances are equal in any engine.
GRAIN = 1_000_000_000
_FAR = np.iinfo(np.int64).max


def near_in_order(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """(n, k): distances max(|dx|, |dy|) to the k nearest others, rising; rows in order of x. Neighbours at growing offsets are met until x alone is farther."""
    n = len(x)
    best = np.full((n, k), _FAR)
    for side in (1, -1):
        live, offset = np.arange(n), 0
        while len(live):
            offset += side
            live = live[(live + offset >= 0) & (live + offset < n)]
            apart = np.abs(x[live + offset] - x[live])
            on = apart < best[live, k - 1]
            live = live[on]
            d = np.maximum(apart[on], np.abs(y[live + offset] - y[live]))
            for c in range(k):  # sink into the sorted row
                was = best[live, c]
                best[live, c], d = np.minimum(was, d), np.maximum(was, d)
    return best


def _near(groups: int, k: int):
    """Rows (group columns..., piece, i, x, y) in order -> (..., best): distances inside the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            keys = pd.DataFrame({str(c): batch.column(c).to_pandas() for c in range(groups + 1)})
            edge = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows], strict=True):
                key = tuple(batch.column(c)[a].as_py() for c in range(groups + 1))
                if key != here and held:
                    yield out(held)
                    held = []
                here = key
                held.append(batch.slice(a, b - a))
        if held:
            yield out(held)

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        best = near_in_order(table.column(groups + 2).to_numpy(), table.column(groups + 3).to_numpy(), k)
        known = best < _FAR
        offsets = np.concatenate(([0], np.cumsum(known.sum(axis=1))))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(best[known]))
        return pa.RecordBatch.from_arrays([*table.columns, lists], [*table.schema.names, "best"])

    return run


def _answers(k: int):
    """Queries that came to a piece, and its points -> the k nearest points of the piece to each query, as far as they are nearer than its bound."""

    def run(asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("x")
        x, y = points["x"].to_numpy(), points["y"].to_numpy()
        found = []
        for qx, qy, r in zip(asked["x"], asked["y"], asked["r"], strict=True):
            a, b = (0, len(x)) if r < 0 else (np.searchsorted(x, qx - r), np.searchsorted(x, qx + r, "right"))
            d = np.maximum(np.abs(x[a:b] - qx), np.abs(y[a:b] - qy))
            found.append(np.sort(np.partition(d, k - 1)[:k] if len(d) > k else d))
        return pd.DataFrame({"i": asked["i"].to_numpy(), "best": found})

    return run


def kth_distances(rows: DataFrame, by: list[str], k: int, parts: int | None = None) -> DataFrame:
    """rows(by..., x, y whole numbers) -> (by..., i, x, y, r): the distance max(|dx|, |dy|) to the k-th nearest other row of the group, null where there are fewer.

    Rows lie in ranges of (group, x). A row whose k-th neighbour in its own range is nearer than the range's edges is done; the others, near
    edges, ask the ranges that their distance so far reaches.
    """
    named = rows.select(*by, "x", "y").repartitionByRange(*([parts] if parts else []), *by, "x", "y").withColumn("piece", F.spark_partition_id()).sortWithinPartitions(*by, "piece", "x")
    points = cut_lineage(named.select(*by, "piece", F.monotonically_increasing_id().alias("i"), "x", "y"))
    fields = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    inside = cut_lineage(points.mapInArrow(_near(len(by), k), f"{fields}, piece int, i bigint, x bigint, y bigint, best array<bigint>"))
    edges = points.groupBy(*by, "piece").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    whole = Window.partitionBy(*by)
    edges = edges.select("*", F.min("piece").over(whole).alias("first"), F.max("piece").over(whole).alias("last")).filter("first < last")  # two rows a range at most
    edges = cut_lineage(edges)
    r = F.try_element_at("best", F.lit(k))
    own = edges.select(*by, "piece", "lo", "hi", "first", "last")
    open_ = inside.join(F.broadcast(own), [*by, "piece"]).withColumn("r", F.coalesce(r, F.lit(-1)))
    open_ = open_.filter("r < 0 or (piece > first and x - lo < r) or (piece < last and hi - x < r)").select(*by, F.col("piece").alias("own"), "i", "x", "y", "r")
    reach = (F.col("r") < 0) | ((F.col("lo") < F.col("x") + F.col("r")) & (F.col("hi") > F.col("x") - F.col("r")))
    asked = open_.join(F.broadcast(edges.select(*by, "piece", "lo", "hi")), by).filter((F.col("piece") != F.col("own")) & reach)
    there = points.join(F.broadcast(edges.select(*by, "piece")), [*by, "piece"])
    more = asked.select(*by, "piece", "i", "x", "y", "r").groupBy(*by, "piece").cogroup(there.groupBy(*by, "piece")).applyInPandas(_answers(k), "i bigint, best array<bigint>")
    more = more.groupBy("i").agg(F.flatten(F.collect_list("best")).alias("more"))
    joined = inside.join(more, "i", "left")
    both = F.array_sort(F.concat("best", F.coalesce("more", F.array().cast("array<bigint>"))))
    return joined.select(*by, "i", "x", "y", F.try_element_at(both, F.lit(k)).alias("r"))


def counts_up_to(points: DataFrame, asked: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """points(by..., v), asked(by..., i, sign, v) -> (by..., i, n): the sum of sign times the number of the group's points that are at most v, for each i."""
    none = F.lit(None).cast("bigint")
    both = points.select(*by, "v", F.lit(0).alias("kind"), none.alias("i"), F.lit(0).alias("sign")).unionByName(asked.select(*by, "v", F.lit(1).alias("kind"), "i", "sign"))
    ranged = cut_lineage(both.repartitionByRange(*([parts] if parts else []), *by, "v", "kind").withColumn("piece", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "piece").agg(F.sum(1 - F.col("kind")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = F.sum(1 - F.col("kind")).over(Window.partitionBy(*by, "piece").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = ranged.withColumn("c", running).filter("kind = 1").join(sizes.select(*by, "piece", before.alias("before")), [*by, "piece"])
    return counted.groupBy(*by, "i").agg(F.sum(F.col("sign") * (F.col("c") + F.col("before"))).alias("n"))


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on: a table of harmonic sums up to 20, then the asymptotic series (error below 1e-12)."""
    small = np.concatenate(([0.0], np.cumsum(1.0 / np.arange(1, 20)))) - 0.5772156649015329
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n <= 20, F.element_at(F.array(*map(F.lit, small.tolist())), F.greatest(F.lit(1), F.least(n, F.lit(20))).cast("int"))).otherwise(series)


def feature_scores(rows: DataFrame, by: list[str], features: list[str], target: str, k: int = 3, parts: int | None = None) -> DataFrame:
    """(by..., feature, n, f_score, mutual_information) of each feature against the target, over all rows of a group, missing values as 0.

    ``f_score`` is r^2 / (1 - r^2) * (n - 2). Mutual information is the estimate by k nearest neighbours (Kraskov) on values divided by their
    deviation and rounded to 1 / GRAIN: psi(n) + psi(k) - mean psi(n_x) - mean psi(n_y), 0 at least, with n_x and n_y the rows strictly nearer than the k-th
    neighbour in one column, the row itself included. Null scores for constant columns and groups of k rows or fewer.
    """
    clean = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    long = rows.select(*by, clean(target).alias("t"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), clean(f).alias("v")) for f in features])).alias("s"))
    long = long.select(*by, "t", "s.feature", "s.v")
    by = [*by, "feature"]
    stats = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("v", "t").alias("c"), F.stddev_pop("v").alias("sv"), F.stddev_pop("t").alias("st"))
    stats = cut_lineage(stats.withColumn("c", F.col("c") / F.nullif(F.col("sv") * F.col("st"), F.lit(0.0))))
    scaled = long.join(stats.filter(f"sv > 0 and st > 0 and n > {k}").select(*by, "sv", "st"), by)
    whole = lambda c, s: F.round(F.col(c) / F.col(s) * GRAIN).cast("long")
    near = cut_lineage(kth_distances(scaled.select(*by, whole("v", "sv").alias("x"), whole("t", "st").alias("y")), by, k, parts))
    axes = near.select(*by, "i", "r", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")))).alias("s")).select(*by, "i", "r", "s.axis", "s.v")
    reach = F.greatest(F.col("r") - 1, F.lit(0))
    edge = F.explode(F.array(F.struct(F.lit(1).alias("sign"), (F.col("v") + reach).alias("v")), F.struct(F.lit(-1).alias("sign"), (F.col("v") - reach - 1).alias("v"))))
    asked = axes.select(*by, "axis", "i", edge.alias("e")).select(*by, "axis", "i", "e.sign", "e.v")
    counts = counts_up_to(axes, asked, [*by, "axis"], parts)
    means = counts.groupBy(*by).agg((F.sum(digamma(F.col("n"))) / F.count(F.lit(1)) * 2).alias("psi"))
    joined = stats.join(means, by, "left")
    shared = F.when(F.col("psi").isNotNull(), F.greatest(digamma(F.col("n")) + digamma(F.lit(k)) - F.col("psi"), F.lit(0.0)))
    r2 = F.col("c") * F.col("c")
    return joined.select(*by, "n", F.when(F.col("c").isNotNull() & (r2 < 1), r2 / (1 - r2) * (F.col("n") - 2)).alias("f_score"), shared.alias("mutual_information"))


def select_features(scores: DataFrame, by: list[str], score: str, most: int) -> DataFrame:
    """(by..., feature, place): the best features of each group by a score of ``feature_scores``; ties by name, missing scores last."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), "feature"))
    return scores.select(*by, "feature", place.alias("place")).filter(F.col("place") <= most)
