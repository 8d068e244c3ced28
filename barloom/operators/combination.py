"""Choosing a combination of factors step by step, and the best parameters of a factor, for any number of groups at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import Expr, evaluate
from barloom.sources.tables import cut_lineage


def _ic_and_wins(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Rows with both, their correlation (null without spread), and the share of equal signs among those without a zero (one half without any)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    told = both & (x != 0) & (y != 0)
    right = F.count_if(told & (F.signum(x) == F.signum(y))) / F.nullif(F.count_if(told), F.lit(0))
    return F.count_if(both), F.when(spread > 1e-14, F.covar_samp(a, b) / spread), F.coalesce(right, F.lit(0.5))


def greedy_combination(rows: DataFrame, by: list[str], names: list[str], ret: str = "ret", most: int = 10, least: int = 10) -> DataFrame:
    """(by..., step, name, score): in each step the factor joins whose mean with the chosen ones scores best, (|IC| + win rate) / 2; ties go by the order of ``names``.

    A row counts where it has a return and half of the tried factors (one at least); the mean takes those it has. Candidates with fewer than ``least`` rows or
    without an IC cannot be chosen. Rows keep the sum and number of their chosen factors, so a step is one pass that tries all candidates of all groups;
    what is exchanged are a few numbers a candidate and group.
    """
    values = {n: F.col(f"`{n}`").cast("double") for n in names}
    rows = cut_lineage(rows.select(*by, *[v.alias(n) for n, v in values.items()], F.col(ret).cast("double").alias("__ret")).filter("__ret is not null"))
    chosen = rows.select(*by).distinct().withColumn("chosen", F.array().cast("array<string>"))
    steps = None
    for step in range(1, min(most, len(names)) + 1):
        held = rows.join(chosen, by)
        inside = {n: F.array_contains("chosen", n) & F.col(f"`{n}`").isNotNull() for n in names}
        held = held.withColumns({"__sum": sum((F.when(inside[n], F.col(f"`{n}`")).otherwise(0.0) for n in names), F.lit(0.0)), "__n": sum((inside[n].cast("int") for n in names), F.lit(0))})
        tried = []
        for i, n in enumerate(names):
            has = F.col(f"`{n}`").isNotNull().cast("int")
            size = F.col("__n") + has
            mean = F.when(size >= max(1, step // 2), (F.col("__sum") + F.coalesce(F.col(f"`{n}`"), F.lit(0.0))) / size)
            count, ic, wins = _ic_and_wins(mean, F.col("__ret"))
            tried.append(F.struct(F.when(count >= least, (F.abs(ic) + wins) / 2).alias("score"), F.lit(-i).alias("i"), F.lit(n).alias("name")).alias(f"t{i}"))
        scored = held.groupBy(*by).agg(F.first("chosen").alias("chosen"), *tried)
        able = F.filter(F.array(*[f"t{i}" for i in range(len(names))]), lambda t: t["score"].isNotNull() & ~F.array_contains("chosen", t["name"]))
        best = cut_lineage(scored.select(*by, "chosen", F.array_max(able).alias("best")))
        found = best.filter("best is not null").select(*by, F.lit(step).alias("step"), F.col("best.name").alias("name"), F.col("best.score").alias("score"))
        steps = found if steps is None else steps.unionByName(found)
        chosen = best.select(*by, F.when(F.col("best").isNotNull(), F.concat("chosen", F.array("best.name"))).otherwise(F.col("chosen")).alias("chosen"))
    return steps


def grid_search(bars: DataFrame, ret: Expr, build: Callable[..., Expr], grid: list[dict], metric: str = "ic", least: int = 10) -> DataFrame:
    """(symbol, place, score): the score of each set of parameters, by its place in the grid. All factors share the sort and the window states of one evaluation.

    metric ic: correlation with the return; effectiveness_score: (|IC| + win rate) / 2; ir: IC over the deviation of the correlations of the last 20 rows (0 without
    deviation; rows with factor and return). Fewer than ``least`` rows, or no IC, give no score.
    """
    if metric not in ("ic", "ir", "effectiveness_score"):
        raise ValueError(f"no metric: {metric!r}")
    made = evaluate(bars, {f"p{i}": build(**params) for i, params in enumerate(grid)} | {"__ret": ret}).filter("__ret is not null")
    long = made.select("symbol", "ts", "__ret", F.posexplode(F.array(*[f"p{i}" for i in range(len(grid))])).alias("place", "x"))
    count, ic, wins = _ic_and_wins(F.col("x"), F.col("__ret"))
    if metric == "ir":
        run = Window.partitionBy("symbol", "place").orderBy("ts").rowsBetween(-19, Window.currentRow)
        spread = F.stddev_samp("x").over(run) * F.stddev_samp("__ret").over(run)
        rolled = F.when((spread > 1e-14) & (F.count(F.lit(1)).over(run) >= 20), F.covar_samp("x", "__ret").over(run) / spread)
        scored = long.filter("x is not null").withColumn("rolled", rolled).groupBy("symbol", "place").agg(count.alias("n"), ic.alias("ic"), F.stddev_samp("rolled").alias("sd"))
        return scored.select("symbol", "place", F.when(F.col("n") >= least, F.when(F.col("sd") > 0, F.col("ic") / F.col("sd")).otherwise(0.0)).alias("score"))
    scored = long.groupBy("symbol", "place").agg(count.alias("n"), ic.alias("ic"), wins.alias("wins"))
    return scored.select("symbol", "place", F.when(F.col("n") >= least, F.col("ic") if metric == "ic" else (F.abs("ic") + F.col("wins")) / 2).alias("score"))


def best_of_grid(scores: DataFrame) -> DataFrame:
    """(symbol, place, score): the best of each symbol, of equal ones the first in the grid."""
    best = F.max(F.struct("score", (-F.col("place")).alias("back"))).alias("best")
    return scores.filter("score is not null").groupBy("symbol").agg(best).select("symbol", (-F.col("best.back")).alias("place"), "best.score")
