"""Likeness of factors over pooled rows: Pearson and Spearman correlation of each pair over the rows that have both, and pairs that are too much alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.tables import cut_lineage

from .association import _ranged
from .selection import correlations, wide


def average_ranks(rows: DataFrame, by: list[str], value: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``rank``, the average rank of ``value`` in its group. A group of any size spreads over ranges of values: ranks inside a range come from
    a running total of distinct values, ranges before it add their sizes. Groups and values must not be null."""
    cells = _ranged(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("w")), by, [value], "piece", parts)
    before = F.sum("w").over(Window.partitionBy(*by, "piece").orderBy(value)) - F.col("w")
    sizes = cells.groupBy(*by, "piece").agg(F.sum("w").alias("size"))
    sizes = sizes.withColumn("offset", F.sum("size").over(Window.partitionBy(*by).orderBy("piece")) - F.col("size")).drop("size")
    ranks = cells.withColumn("before", before).join(sizes, [*by, "piece"])
    ranks = ranks.select(*by, value, (F.col("offset") + F.col("before") + (F.col("w") + 1) / 2).alias("rank"))
    return rows.join(ranks, [*by, value])


def _pair_sums(pairs: list[tuple[int, int]]):
    """Sums of each pair's numbers and products over rows of one array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pairs), 6))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            on = np.isfinite(x)
            for at, (i, j) in enumerate(pairs):
                both = on[i] & on[j]
                a, b = x[i][both], x[j][both]
                total[at] += (both.sum(), a.sum(), b.sum(), a @ a, b @ b, a @ b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs), dtype=np.int32)), *[pa.array(c.copy()) for c in total.T]], ["pair", "n", "sx", "sy", "sxx", "syy", "sxy"])

    return run


def rank_correlations(table: DataFrame, key: list[str], names: list[str], least: int = 2, parts: int | None = None) -> DataFrame:
    """table(key..., c0, c1, ...) of ``wide`` -> (a, b, spearman): correlation of average ranks over the rows that have both.

    A factor is ranked once for all partners whose rows include its own, and once more for each partner that lacks some of them; with equal
    rows everywhere that is one ranking a factor.
    """
    k = len(names)
    known = table.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(k)]).head()
    counts = {(r["a"], r["b"]): r["n"] for r in correlations(table, names, 1).collect()}  # k * k rows
    place: dict[tuple[int, int], int] = {}  # (factor, partner, or itself) -> number of the ranking
    pairs = []
    for i in range(k):
        for j in range(i + 1, k):
            if counts.get((names[i], names[j]), 0) >= max(2, least):
                n = counts[names[i], names[j]]
                sides = [(i, i if known[f"n{i}"] == n else j), (j, j if known[f"n{j}"] == n else i)]
                pairs.append((i, j, *[place.setdefault(s, len(place)) for s in sides]))
    out = "a string, b string, spearman double"
    if not pairs:
        return table.sparkSession.createDataFrame([], out)
    one = [F.when(F.col(f"c{j}").isNotNull(), F.struct(F.lit(r).alias("ranking"), F.col(f"c{i}").alias("value"))) for (i, j), r in place.items()]
    rows = table.select(*key, F.explode(F.array(*one)).alias("of")).filter("of.value is not null").select(*key, "of.ranking", "of.value")
    ranked = average_ranks(rows, ["ranking"], "value", parts)
    spread = ranked.groupBy(*key).agg(*[F.max(F.when(F.col("ranking") == r, F.col("rank"))).alias(f"r{r}") for r in range(len(place))])
    sums = spread.drop(*key).mapInArrow(_pair_sums([p[2:] for p in pairs]), "pair int, n double, sx double, sy double, sxx double, syy double, sxy double")
    sums = sums.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    both = F.sqrt(F.greatest((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")), F.lit(0.0)))
    r = F.when(both > 1e-9, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / both)
    called = [F.element_at(F.array(*[F.lit(names[p[side]]) for p in pairs]), F.col("pair") + 1) for side in (0, 1)]
    return sums.select(called[0].alias("a"), called[1].alias("b"), r.alias("spearman"))


def likeness(table: DataFrame, key: list[str], names: list[str], least: int = 10, limit: float = 0.7, parts: int | None = None) -> DataFrame:
    """table of ``wide`` -> (a, b, n, pearson, spearman, max_abs, alike): each pair with ``least`` common rows; alike where the larger of both correlations,
    in absolute value, reaches ``limit``. A correlation without variance is null and counts as 0."""
    r = correlations(table, names, least).withColumnRenamed("correlation", "pearson")
    r = r.join(rank_correlations(table, key, names, least, parts), ["a", "b"], "left")
    size = F.greatest(*[F.coalesce(F.abs(c), F.lit(0.0)) for c in ("pearson", "spearman")])
    return r.withColumn("max_abs", size).withColumn("alike", F.col("max_abs") >= limit)


def factor_likeness(long: DataFrame, names: list[str], flipped: tuple[str, ...] = (), key: tuple[str, ...] = ("symbol", "ts"), least: int = 10, limit: float = 0.7, parts: int | None = None) -> DataFrame:
    """long(key..., name, value) -> ``likeness`` over pooled rows. ``flipped`` factors (those with a negative IC) change sign; of repeated keys the largest
    value counts; null, NaN and infinite values are missing."""
    value = F.col("value").cast("double")
    rows = long.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))).withColumn("value", F.when(F.col("name").isin(*flipped), -value).otherwise(value) if flipped else value)
    return likeness(cut_lineage(wide(rows, list(key), names, "value")), list(key), names, least, limit, parts)


def ic_likeness(ic: DataFrame, names: list[str], least: int = 30, limit: float = 0.7, parts: int | None = None) -> DataFrame:
    """ic(ts, name, ic) -> (mode, aligned, ...) of ``likeness`` over dates.

    All pairs take the dates on which every factor has an IC (``intersection``). If these are fewer than ``least`` though there are as many dates
    at all, each pair takes its own and needs ``least`` of them (``pairwise``). aligned is the number of dates used. ICs are rounded to 1e-12, so that
    equal ones tie in whatever order they were summed up.
    """
    table = cut_lineage(wide(ic.withColumn("ic", F.round("ic", 12)), "ts", names, "ic"))
    whole = F.lit(True)
    for i in range(len(names)):
        whole = whole & F.col(f"c{i}").isNotNull()
    n = table.agg(F.count(F.lit(1)).alias("dates"), F.count_if(whole).alias("complete")).head()
    pairwise = n["complete"] < least <= n["dates"]
    mode, aligned = ("pairwise", n["dates"]) if pairwise else ("intersection", n["complete"])
    found = likeness(table if pairwise else table.filter(whole), ["ts"], names, least if pairwise else 2, limit, parts)
    return found.select(F.lit(mode).alias("mode"), F.lit(aligned).cast("long").alias("aligned"), *found.columns)
