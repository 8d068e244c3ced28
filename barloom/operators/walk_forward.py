"""Walk-forward comparison of ways to weigh factors, out of sample.

Ranks, composites and portfolios of a date need that date's rows alone, so the panel is dealt by date once. The training window of every split is the
difference of two running sums over the dates, and a date finds its splits by arithmetic; no range is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.tables import cut_lineage

from .rolling_weights import ICSums
from .selection import unit_l1

METHODS = ("equal_weight", "ic_weight", "max_icir_weight")
_DAY = 86400


def _corr(x: Column, y: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(spread > 1e-14, F.covar_samp(x, y) / spread)


def ranked_dates(panel: DataFrame, names: list[str]) -> DataFrame:
    """panel(name, symbol, ts, factor, ret) -> (ts, symbol, ret, rr, ranks): average ranks of the return and of each factor among the date's known ones. Dealt by date."""
    rows = panel.filter("ret is not null").repartition("ts")

    def rank(c: str) -> Column:
        by = Window.partitionBy("ts", "name")
        place = F.rank().over(by.orderBy(F.asc_nulls_last(c))) + (F.count(F.lit(1)).over(Window.partitionBy("ts", "name", c)) - 1) / 2
        return F.when(F.col(c).isNotNull(), place)

    rows = rows.select("ts", "symbol", "name", "ret", rank("factor").alias("rf"), rank("ret").alias("rr"))
    ranks = F.array(*[F.max(F.when(F.col("name") == n, F.col("rf"))) for n in names])
    return rows.groupBy("ts", "symbol").agg(F.first("ret").alias("ret"), F.max("rr").alias("rr"), ranks.alias("ranks"))


def split_weights(ics: DataFrame, names: list[str], start: Column, splits: int, train: float, step: float, ridge: float = 1e-6) -> DataFrame:
    """ics(ts, ic0...) -> (split, method, weights): of each split's training dates, a row for each method.

    Dates and the edges of all training windows are put in order, one row each, and summed up on the way; a window is its end's sums minus its start's.
    """
    k = len(names)
    x = [F.col(f"ic{i}") for i in range(k)]
    known = F.greatest(*[c.isNotNull().cast("double") for c in x], F.lit(0.0))
    zero = [F.coalesce(c, F.lit(0.0)) for c in x]
    terms = [known, *[c.isNotNull().cast("double") for c in x], *ICSums.terms(zero)]
    width = len(terms)
    dated = ics.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("split"), F.lit(0).alias("sign"), F.array(*terms).alias("x"))
    spark = ics.sparkSession
    numbers = spark.range(splits).select(F.col("id").cast("int").alias("split"))
    edge = lambda days, sign: numbers.select((start + (F.col("split") * float(step) + float(days)) * (_DAY * 1e6)).cast("long").alias("at"), F.lit(0).alias("kind"), "split", F.lit(sign).alias("sign"), F.array(*[F.lit(0.0)] * width).alias("x"))
    line = dated.unionByName(edge(0.0, -1)).unionByName(edge(train, 1))  # an edge comes before a date at the same time
    run = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = line.select("kind", "split", "sign", F.array(*[F.sum(F.col("x")[i]).over(run) for i in range(width)]).alias("sums")).filter("kind = 0")
    windows = sums.groupBy("split").agg(F.array(*[F.sum(F.col("sign") * F.col("sums")[i]) for i in range(width)]).alias("sums"))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            splits_, methods, weights = [], [], []
            for split, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.array(values)
                n, counts, sums_ = s[0], s[1 : k + 1], ICSums(s[None, k + 1 :], s[:1], k)
                mean = np.divide(sums_.first[0], counts, out=np.zeros(k), where=counts > 0)
                equal = np.full(k, 1.0 / k)
                found = {"equal_weight": equal, "ic_weight": equal, "max_icir_weight": equal}
                if n >= max(5, k):
                    cov = sums_.shrunk()[0] if n > k else sums_.covariance()[0] * n / (n - 1)
                    found |= {"ic_weight": unit_l1(mean), "max_icir_weight": unit_l1(np.linalg.lstsq(cov + ridge * np.eye(k), mean, rcond=None)[0])}
                for method in METHODS:
                    splits_.append(split)
                    methods.append(method)
                    weights.append(found[method].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(splits_, pa.int32()), pa.array(methods), pa.array(weights, pa.list_(pa.float64()))], ["split", "method", "weights"])

    return windows.mapInArrow(weighed, "split int, method string, weights array<double>")


def out_of_sample(panel: DataFrame, names: list[str], train: float, oos: float, step: float, groups: int = 5, cost: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """((method, ts, split, ic, ls, turnover, net), (split, method, weights)): each method's composite of ranks on the dates after each training window.

    Of dates that several splits try, the last split's stays. The composite leaves factors without rank out; the outer n // ``groups`` symbols of a date (of
    2 * groups and 4 at least) are held long and short, ties by symbol. Turnover is half the change of weights since the split's date before. Windows are in days.
    """
    ranked = cut_lineage(ranked_dates(panel, names))
    ends = ranked.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at")).head()
    splits = 0
    while ends["a"] is not None and ends["a"] + timedelta(days=splits * step + train + oos) <= ends["b"] + timedelta(hours=23):
        splits += 1
    start = F.lit(ends["at"] if splits else 0)
    ics = ranked.groupBy("ts").agg(*[_corr(F.col("ranks")[i], F.col("rr")).alias(f"ic{i}") for i in range(len(names))])
    weights = cut_lineage(split_weights(ics, names, start, splits, train, step))
    # days since the first date, less the training window: split s tries those from s * step up to s * step + oos
    train, oos, step = float(train), float(oos), float(step)
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - start) / (_DAY * 1e6) - train
    first, last = F.greatest(F.lit(0), F.floor((days - oos) / step) + 1), F.least(F.lit(splits - 1), F.floor(days / step))
    tried = ranked.filter((last >= first) & (F.lit(splits) > 0)).select("ts", "symbol", "ret", "rr", "ranks", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("split"))
    tried = tried.join(F.broadcast(weights), "split")  # a row for each split and method
    used = F.zip_with("ranks", "weights", lambda r, w: F.when(w != 0, r * w))
    some = F.exists(used, lambda v: v.isNotNull())
    composite = F.when(some, F.aggregate(used, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))))
    scored = tried.select("split", "method", "ts", "symbol", "ret", "rr", F.round(composite, 9).alias("comp")).filter("comp is not null")
    day = ["split", "method", "ts"]
    whole = Window.partitionBy(*day)
    placed = scored.withColumns({"n": F.count(F.lit(1)).over(whole), "i": F.row_number().over(whole.orderBy(F.desc("comp"), "symbol"))})
    held = F.greatest(F.lit(1), F.floor(F.col("n") / groups))
    enough = F.col("n") >= max(2 * groups, 4)
    side = F.when(enough & (F.col("i") <= held), 1.0).when(enough & (F.col("i") > F.col("n") - held), -1.0)
    placed = placed.withColumns({"side": side, "held": held})
    leg = lambda s: F.avg(F.when(F.col("side") == s, F.col("ret")))
    dates = cut_lineage(placed.groupBy(*day).agg(_corr(F.col("comp"), F.col("rr")).alias("ic"), (leg(1.0) - leg(-1.0)).alias("ls")))
    run = Window.partitionBy("split", "method").orderBy("ts")
    near = dates.filter("ls is not null").select(*day, F.lag("ts").over(run).alias("before"), F.lead("ts").over(run).alias("after"))
    members = placed.filter("side is not null").select(*day, "symbol", (F.col("side") / F.col("held")).alias("w")).join(near, day)
    own = Window.partitionBy("split", "method", "symbol").orderBy("ts")
    members = members.withColumns({"was": F.when(F.lag("ts").over(own) == F.col("before"), F.lag("w").over(own)), "stays": F.coalesce(F.lead("ts").over(own) == F.col("after"), F.lit(False))})
    moved = members.filter("before is not null").select(*day, F.abs(F.col("w") - F.coalesce("was", F.lit(0.0))).alias("d"))
    left = members.filter("after is not null and not stays").select("split", "method", F.col("after").alias("ts"), F.abs("w").alias("d"))
    turnover = moved.unionByName(left).groupBy(*day).agg((F.sum("d") / 2).alias("turnover"))
    out = dates.join(turnover, day, "left").withColumn("net", F.col("ls") - F.coalesce("turnover", F.lit(0.0)) * cost)
    latest = F.row_number().over(Window.partitionBy("method", "ts").orderBy(F.desc("split")))
    return out.withColumn("k", latest).filter("k = 1").select("method", "ts", "split", "ic", "ls", "turnover", "net"), weights


def method_summary(dates: DataFrame) -> DataFrame:
    """A row for each method of ``out_of_sample``: ICs, long-short returns before and after cost, Sharpe ratios of 252 periods a year, totals and drawdowns compounded."""
    run = Window.partitionBy("method").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = {f"{c}_grown": F.product(1 + F.coalesce(c, F.lit(0.0))).over(run) for c in ("ls", "net")}
    made = dates.withColumns(grown)
    made = made.withColumns({f"{c}_fall": F.when(F.col(c).isNotNull(), F.col(f"{c}_grown") / F.nullif(F.max(F.when(F.col(c).isNotNull(), F.col(f"{c}_grown"))).over(run), F.lit(0.0)) - 1) for c in ("ls", "net")})
    sharpe = lambda c: F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c) * 252**0.5)
    total = lambda c: F.when(F.count(c) > 0, F.max_by(f"{c}_grown", "ts") - 1)
    spread = F.when(F.stddev_samp("ic") > 0, F.stddev_samp("ic"))
    return made.groupBy("method").agg(
        F.countDistinct("split").alias("splits"), F.count("ls").alias("n_periods"), F.count("ic").alias("n_ic_periods"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), (F.avg("ic") / spread).alias("icir"),
        (F.avg("ic") * F.sqrt(F.count("ic")) / spread).alias("ic_tstat"), F.avg("ls").alias("ls_mean"), total("ls").alias("ls_total"), total("net").alias("ls_total_after_cost"), sharpe("ls").alias("sharpe"), sharpe("net").alias("sharpe_after_cost"),
        F.min("ls_fall").alias("max_drawdown"), F.min("net_fall").alias("max_drawdown_after_cost"), F.avg("turnover").alias("turnover_mean"),
    )


def two_sided_p(t: float, freedom: float) -> float:
    """Probability of a Student t at least as far from 0: the incomplete beta function by its continued fraction."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
        h = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1.0 + step * d)
                c = 1.0 + step / c
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * fraction(b, a, 1 - x) / b


def paired_tests(dates: DataFrame, least: int = 10) -> DataFrame:
    """(method_a, method_b, n, mean_diff, std_diff, t_stat, p_value): paired t tests of the net returns of each two methods on the dates that both have; no test with fewer than ``least``."""
    wide = dates.groupBy("ts").agg(*[F.max(F.when(F.col("method") == m, F.col("net"))).alias(m) for m in METHODS])
    pairs = [(a, b) for i, a in enumerate(METHODS) for b in METHODS[i + 1 :]]
    gaps = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs])).alias("s")).select("s.*").filter("d is not null")
    found = gaps.groupBy("method_a", "method_b").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("std_diff"))
    found = found.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("mean_diff", "std_diff")})
    found = found.withColumn("t_stat", F.when(F.col("std_diff") > 0, F.col("mean_diff") / F.col("std_diff") * F.sqrt("n")))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else two_sided_p(a, b - 1) for a, b in zip(t, n, strict=True)], dtype=float)

    return found.withColumn("p_value", p_value("t_stat", "n"))  # a row for each two methods
