"""Scan of the latest bars: each factor's last value, scored across symbols, weighted into one score a symbol, and the best and worst symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.tables import cut_lineage

from .similarity import average_ranks


def latest_values(long: DataFrame, fresh_from=None) -> DataFrame:
    """long(symbol, ts, name, value) -> (symbol, name, value) at each factor's last row; null, NaN and infinite last values are left out.

    With ``fresh_from``, symbols whose last row of any factor is older are left out as well.
    """
    last = long.groupBy("symbol", "name").agg(F.max_by(F.col("value").cast("double"), "ts").alias("value"), F.max("ts").alias("ts"))
    if fresh_from is not None:
        fresh = last.groupBy("symbol").agg(F.max("ts").alias("seen")).filter(F.col("seen") >= F.lit(fresh_from)).select("symbol")
        last = last.join(fresh, "symbol")
    return last.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))).select("symbol", "name", "value")


def _clipped(values: DataFrame, outlier: str, mad_n: float) -> DataFrame:
    """Values drawn to the limits of their factor, for factors with three values or more."""
    if outlier == "none":
        return values
    if outlier == "mad":
        middle = values.groupBy("name").agg(F.expr("percentile(value, 0.5)").alias("m"), F.count(F.lit(1)).alias("k"))
        apart = values.join(middle, "name").groupBy("name", "m", "k").agg(F.expr("percentile(abs(value - m), 0.5)").alias("d"))
        limits = apart.select("name", (F.col("m") - mad_n * F.col("d")).alias("lo"), (F.col("m") + mad_n * F.col("d")).alias("hi"), ((F.col("k") >= 3) & (F.col("d") > 0)).alias("cut"))
    elif outlier == "winsor":
        limits = values.groupBy("name").agg(F.expr("percentile(value, 0.01)").alias("lo"), F.expr("percentile(value, 0.99)").alias("hi"), F.count(F.lit(1)).alias("k"))
        limits = limits.select("name", "lo", "hi", ((F.col("k") >= 3) & (F.col("lo") < F.col("hi"))).alias("cut"))
    else:
        raise ValueError(f"outlier must be none, mad or winsor, not {outlier!r}")
    inside = F.when(F.col("cut"), F.greatest(F.least("value", "hi"), "lo")).otherwise(F.col("value"))
    return values.join(limits, "name").withColumn("used", inside).select("symbol", "name", "value", "used")


def _of(name: Column, values: dict[str, float], default: float) -> Column:
    known = F.create_map(*[F.lit(x) for n, v in values.items() for x in (n, float(v))]) if values else None
    return F.coalesce(known[name], F.lit(default)) if values else F.lit(default)


def factor_scores(latest: DataFrame, directions: dict[str, int] | None = None, normalise: str = "rank_centered", outlier: str = "none", mad_n: float = 3.0, least: int = 2, parts: int | None = None) -> DataFrame:
    """(symbol, name, value, coverage, place, score) for factors that ``least`` symbols (two at least) have.

    ``rank_centered`` scores run from -1 to 1, ``rank`` from 0 to 1, ``raw`` are the clipped values; direction -1 turns them round. place counts from the largest
    clipped value (average of ties, cut to whole numbers), whatever the direction. Ranks are taken in ranges of values, so a factor's symbols need no single task.
    """
    if normalise not in ("rank_centered", "rank", "raw"):
        raise ValueError(f"normalise must be rank_centered, rank or raw, not {normalise!r}")
    covered = latest.groupBy("name").agg(F.count(F.lit(1)).alias("coverage")).filter(F.col("coverage") >= max(2, least))
    used = _clipped(latest, outlier, mad_n) if outlier != "none" else latest.withColumn("used", F.col("value"))
    ranked = average_ranks(cut_lineage(used.join(covered, "name")), ["name"], "used", parts)
    share = (F.col("rank") - 1) / (F.col("coverage") - 1)
    up = {"rank_centered": 2 * share - 1, "rank": share, "raw": F.col("used")}[normalise]
    down = 1 - up if normalise == "rank" else -up
    turned = _of(F.col("name"), {n: d for n, d in (directions or {}).items()}, 1.0) == -1
    place = (F.col("coverage") + 1 - F.col("rank")).cast("int")
    return ranked.select("symbol", "name", "value", "coverage", place.alias("place"), F.when(turned, down).otherwise(up).alias("score"))


def composite(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(symbol, factors, score): mean of a symbol's scores, or with ``weights`` their weighted sum over the sum of absolute weights of the factors it has
    (1 for factors without a weight; the plain mean where all weights are 0)."""
    if weights is None:
        return scores.groupBy("symbol").agg(F.count(F.lit(1)).alias("factors"), F.avg("score").alias("score"))
    w = _of(F.col("name"), weights, 1.0)
    size = F.sum(F.abs(w))
    return scores.groupBy("symbol").agg(F.count(F.lit(1)).alias("factors"), F.when(size > 0, F.sum(F.col("score") * w) / F.nullif(size, F.lit(0.0))).otherwise(F.avg("score")).alias("score"))


def best_and_worst(scored: DataFrame, longs: int, shorts: int) -> DataFrame:
    """(side, place, symbol, factors, score): the ``longs`` highest and ``shorts`` lowest scores; ties go by symbol, in reverse for shorts. Each side is a top-k
    of its own, merged from the tasks' tops. Symbols without a score are on neither side."""

    def side(name: str, order: list[Column], k: int) -> DataFrame:
        top = scored.orderBy(*order).limit(k).agg(F.array_agg(F.struct("score", "symbol", "factors")).alias("rows"))
        before = lambda a, b: F.when((a["score"] == b["score"]) & (a["symbol"] == b["symbol"]), 0).when((a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["symbol"] < b["symbol"])), -1).otherwise(1)
        sign = 1 if name == "long" else -1
        rows = F.array_sort("rows", lambda a, b: before(a, b) * sign)
        return top.select(F.lit(name).alias("side"), F.posexplode(rows).alias("at", "row")).select("side", (F.col("at") + 1).alias("place"), "row.symbol", "row.factors", "row.score")

    return side("long", [F.desc("score"), F.asc("symbol")], longs).unionByName(side("short", [F.asc("score"), F.desc("symbol")], shorts))
