"""Cross-sectional evaluation of any factors: a plan that turns bars into a panel, and all measures of the panel in one pass.

``prepare_panel`` computes the factors and the future return in the same staged windows by symbol, delays the signal, treats outliers, and cuts dates;
``evaluate_panel`` then deals the panel by (factor, date) once for ranks, gates, groups and moments, by (factor, symbol) once for what depends on the date before, and
works on one row a date from there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import Expr, col, evaluate, lag, lead
from barloom.sources.tables import cut_lineage

from .library import seconds_of, signal_lag


@dataclass(frozen=True)
class PanelPlan:
    """How a panel is made. ``lag`` is the delay in bars of the signals (see ``library.signal_lag``), ``step`` the bars of the future return; every ``sample``-th date
    of the panel is kept, and dates from ``start`` on. ``mode`` is the factor's bars: same as the base bars, completed bars of ``timeframe``, or intrabar (the bar of
    that timeframe as it looks at each base bar). ``outliers`` is None, mad or winsor, within the symbol's signals of each ``outlier_minutes``."""

    step: int = 1
    lag: int = 1
    sample: int = 1
    start: str | None = None
    mode: str = "same"
    timeframe: str = "4h"
    clean: bool = False
    outliers: str | None = None
    outlier_minutes: int = 30
    mads: float = 5.0
    lower: float = 0.01
    upper: float = 0.99

    @classmethod
    def for_factor(cls, metadata: dict | None = None, params: dict | None = None, **settings) -> PanelPlan:
        return cls(lag=signal_lag(metadata, params), **settings)


def _seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def higher_bars(bars: DataFrame, timeframe: str) -> DataFrame:
    """Completed bars of a higher timeframe: intervals closed and labelled at their right end; the one still open at the end is left out."""
    size = seconds_of(timeframe)
    secs = _seconds(F.col("ts"))
    known = bars.select("symbol", "open", "high", "low", "close", "volume", "ts", (F.ceil(secs / size) * size).alias("ends"), F.max(secs).over(Window.partitionBy("symbol")).alias("last"))
    made = known.filter(F.col("ends") <= F.floor(F.col("last") / size) * size).groupBy("symbol", "ends")
    made = made.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return made.select("symbol", F.timestamp_seconds("ends").cast(bars.schema["ts"].dataType).alias("ts"), "open", "high", "low", "close", "volume")


def partial_bars(bars: DataFrame, timeframe: str) -> DataFrame:
    """At each base bar the bar of a higher timeframe as it looks so far (intervals closed at their left end)."""
    size = seconds_of(timeframe)
    bucket = bars.withColumn("__bucket", F.floor(_seconds(F.col("ts")) / size))
    run = Window.partitionBy("symbol", "__bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bucket.select("symbol", "ts", F.first("open").over(run).alias("open"), F.max("high").over(run).alias("high"), F.min("low").over(run).alias("low"), "close", F.sum("volume").over(run).alias("volume"))


def _signals(bars: DataFrame, factors: dict[str, Expr], plan: PanelPlan) -> DataFrame:
    """(symbol, ts, factors..., __ret): the factors at each base bar, not yet delayed."""
    ret = {"__ret": lead(col("close"), plan.step) / col("close") - 1.0}
    if plan.mode == "same":
        return evaluate(bars, factors | ret)
    base = evaluate(bars, ret)
    if plan.mode == "intrabar":
        return base.join(evaluate(partial_bars(bars, plan.timeframe), factors), ["symbol", "ts"], "left")
    if plan.mode != "completed":
        raise ValueError(f"no bar mode: {plan.mode!r}")
    made = evaluate(higher_bars(bars, plan.timeframe), factors)
    names = list(factors)
    side = made.select("symbol", "ts", F.lit(0).alias("side"), F.struct(*names).alias("f"), F.lit(None).cast("double").alias("__ret"))
    both = side.unionByName(base.select("symbol", "ts", F.lit(1).alias("side"), F.lit(None).cast(side.schema["f"].dataType).alias("f"), "__ret"))
    latest = F.last("f", True).over(Window.partitionBy("symbol").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("f", latest).filter("side = 1").select("symbol", "ts", *[F.col("f")[n].alias(n) for n in names], "__ret")


def _clipped(value: Column, plan: PanelPlan, group) -> Column:
    if plan.outliers == "winsor":
        low, high = (F.percentile(value, F.lit(q)).over(group) for q in (plan.lower, plan.upper))
        return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))
    return value


def prepare_panel(bars: DataFrame, factors: dict[str, Expr], plan: PanelPlan | None = None) -> DataFrame:
    """bars -> (name, symbol, ts, factor, ret): rows with a future return; a factor may be missing there.

    The order is that of a backtest: clean, factor, delay by ``lag`` bars, outliers, return, sampled dates, out-of-sample cut. Dates are numbered over
    one row a date.
    """
    plan = plan or PanelPlan()
    if plan.clean:
        run = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bars = bars.withColumns({c: F.last(c, True).over(run) for c in ("open", "high", "low", "close", "volume")}).filter("volume > 0")
    names = list(factors)
    delayed = {n: f if plan.mode != "same" else lag(f, plan.lag) for n, f in factors.items()}
    made = _signals(bars, delayed, plan)
    if plan.mode != "same":  # delayed in base bars, not in bars of the higher timeframe
        by = Window.partitionBy("symbol").orderBy("ts")
        made = made.withColumns({n: F.lag(n, plan.lag).over(by) for n in names}) if plan.lag else made
    if plan.outliers:
        group = Window.partitionBy("symbol", "__group")
        made = made.withColumn("__group", F.floor(_seconds(F.col("ts")) / (60 * plan.outlier_minutes)))
        if plan.outliers == "mad":
            made = made.withColumns({f"__m{i}": F.percentile(n, F.lit(0.5)).over(group) for i, n in enumerate(names)})
            made = made.withColumns({f"__d{i}": F.percentile(F.abs(F.col(n) - F.col(f"__m{i}")), F.lit(0.5)).over(group) for i, n in enumerate(names)})
            clip = lambda i, n: F.when(F.col(f"__d{i}") > 0, F.when(F.col(n).isNotNull(), F.least(F.greatest(F.col(n), F.col(f"__m{i}") - plan.mads * F.col(f"__d{i}")), F.col(f"__m{i}") + plan.mads * F.col(f"__d{i}")))).otherwise(F.col(n))
            made = made.withColumns({n: clip(i, n) for i, n in enumerate(names)})
        else:
            made = made.withColumns({n: _clipped(F.col(n), plan, group) for n in names})
    made = made.filter("__ret is not null")
    if plan.sample > 1:
        dates = made.select("ts").distinct().withColumn("__i", F.row_number().over(Window.orderBy("ts")) - 1)
        made = made.join(dates.filter(F.col("__i") % plan.sample == 0).select("ts"), "ts")
    if plan.start:
        made = made.filter(F.col("ts") >= F.lit(plan.start).cast("timestamp"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("factor")) for n in names]))
    return made.select("symbol", "ts", F.col("__ret").alias("ret"), each.alias("s")).select("s.name", "symbol", "ts", "s.factor", "ret")


def periods_per_year(timeframe: str) -> float:
    """Bars a year, weeks counted as 52."""
    size = seconds_of(timeframe)
    return 52.0 if timeframe == "1w" else 365 * 86400 / size


def _rank(of: str, by: list[str]) -> Column:
    """Average rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(of)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, of)) - 1) / 2


def _correlation(x: str | Column, y: str | Column) -> Column:
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(spread > 1e-14, F.covar_samp(x, y) / spread)


def date_measures(panel: DataFrame, groups: int = 5, min_coverage: float = 0.3, min_valid: int = 30, min_group: int = 5, zero_invalid: bool = True, fsc: bool = True) -> DataFrame:
    """panel(name, symbol, ts, factor, ret) -> a row for each factor and date that passes the gates: coverage, valid, ic (of the factor's ranks), rank_ic, means (of each
    group's returns), turnover of the outer groups against the factor's date before, and fsc (rank correlation of the signals with those of that date).

    Gates: the larger of ``min_valid``, ``groups * min_group`` and 10 rows and as many valid ones, a share of ``min_coverage`` valid. Valid are finite signals and returns,
    signals of 0 only if ``zero_invalid`` is off. A date without spread of signals or returns has no ic, but groups. Ties of a group's border go by symbol.
    """
    least = max(min_valid, groups * min_group, 10)
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    valid = finite("factor") & finite("ret") & ((F.col("factor") != 0) if zero_invalid else F.lit(True))
    day = ["name", "ts"]
    whole = Window.partitionBy(*day)
    rows = panel.select(*day, "symbol", F.col("factor").cast("double").alias("factor"), F.col("ret").cast("double").alias("ret"))
    rows = rows.withColumns({"__ok": F.coalesce(valid, F.lit(False)), "total": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumn("valid", F.sum(F.col("__ok").cast("long")).over(whole))
    rows = rows.filter((F.col("total") >= least) & (F.col("valid") >= least) & (F.col("valid") / F.col("total") >= min_coverage) & F.col("__ok"))
    place = F.row_number().over(whole.orderBy("factor", "symbol"))
    rows = rows.withColumns({"rf": _rank("factor", day), "rr": _rank("ret", day), "grp": F.greatest(F.lit(0), F.ceil((place - 1) * F.lit(float(groups)) / (F.col("valid") - 1)).cast("int") - 1)})
    rows = cut_lineage(rows.drop("__ok"))  # read again below; dealt by date
    # the factor's dates in order: one row a date
    dates = rows.groupBy(*day).agg(
        F.first("total").alias("total"), F.first("valid").alias("valid"), _correlation("rf", "ret").alias("ic"), _correlation("rf", "rr").alias("rank_ic"),
        F.array(*[F.avg(F.when(F.col("grp") == g, F.col("ret"))) for g in range(groups)]).alias("means"),
        F.sum((F.col("grp") == groups - 1).cast("long") + (F.col("grp") == 0).cast("long")).alias("outer"),
    )
    dates = cut_lineage(dates.withColumn("before", F.lag("ts").over(Window.partitionBy("name").orderBy("ts"))))
    held = rows.select(*day, "symbol", "grp", "rf").join(dates.select(*day, "before"), day)
    by_symbol = Window.partitionBy("name", "symbol").orderBy("ts")
    there = F.lag("ts").over(by_symbol) == F.col("before")
    held = held.withColumns({"was": F.when(there, F.lag("grp").over(by_symbol)), "rw": F.when(there, F.lag("rf").over(by_symbol))})
    outer = F.col("grp").isin(0, groups - 1)
    moved = (outer & (F.col("was").isNull() | (F.col("was") != F.col("grp")))).cast("long")
    held = held.select(*day, moved.alias("moved"), "rf", "rw", F.col("rw").isNotNull().alias("common"))
    measures = [F.sum("moved").alias("moved")]
    if fsc:  # ranks among the symbols of both dates
        held = held.withColumns({"a": _rank("rf", [*day, "common"]), "b": _rank("rw", [*day, "common"])})
        both = lambda c: F.when(F.col("common"), F.col(c))
        measures.append(F.when(F.count_if("common") >= max(min_group, 5), _correlation(both("a"), both("b"))).alias("fsc"))
    out = dates.join(held.groupBy(*day).agg(*measures), day)
    out = out if fsc else out.withColumn("fsc", F.lit(None).cast("double"))
    turnover = F.when(F.col("before").isNotNull(), F.col("moved") / F.col("outer"))
    return out.select(*day, (F.col("valid") / F.col("total")).alias("coverage"), "valid", "ic", "rank_ic", "means", turnover.alias("turnover"), "fsc")


def _over_sqrt(mean: Column, std: Column, n: Column) -> Column:
    return F.when((n >= 2) & (std > 0), mean * F.sqrt(n) / std)


def evaluate_panel(panel: DataFrame, timeframe: str = "1d", cost: float = 0.001, segments: int = 4, groups: int = 5, **gates) -> DataFrame:
    """A row for each factor of panel(name, symbol, ts, factor, ret): sizes and skip rates; mean, deviation, ratio and t value of the ICs, how many segments of dates agree
    in sign; long-short returns before and after cost with Sharpe ratios, annualised ones, totals, drawdowns, turnover, monotonicity and fsc.

    The cost of a period is mean turnover times ``cost``, or twice ``cost`` where no turnover is known. Drawdowns are of compounded returns. Factors without any date
    that passes the gates have their sizes alone.
    """
    dates = cut_lineage(date_measures(panel, groups=groups, **gates))
    count = lambda c: F.sum(c.cast("long"))
    sizes = panel.groupBy("name").agg(F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("ts").alias("n_periods"))

    # ICs: dates with either one, in `segments` runs of at least five dates
    ics = dates.filter("ic is not null or rank_ic is not null")
    by_name = Window.partitionBy("name")
    n, i = F.count(F.lit(1)).over(by_name), F.row_number().over(by_name.orderBy("ts")) - 1
    parts = F.greatest(F.lit(1), F.least(F.lit(segments), F.floor(n / 5))).cast("int")
    ics = ics.withColumns({"n": n, "i": i, "parts": parts}).withColumns({"q": F.floor(F.col("n") / F.col("parts")), "r": F.col("n") % F.col("parts")})
    long = F.col("r") * (F.col("q") + 1)  # the first r runs have one date more
    ics = ics.withColumn("part", F.when(F.col("i") < long, F.floor(F.col("i") / (F.col("q") + 1))).otherwise(F.col("r") + F.floor((F.col("i") - long) / F.col("q"))))
    runs = ics.groupBy("name", "part").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"))
    ic = ics.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_periods_ic"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_samp("rank_ic").alias("rank_ic_std"),
        (count(F.col("ic") > 0) / F.nullif(F.count("ic"), F.lit(0))).alias("ic_positive_ratio"), F.avg("valid").alias("avg_symbols"),
    )
    same = lambda c: count(F.when((F.signum(f"r.{c}") == F.signum(f"{c}_mean")) & (F.col(f"{c}_mean") != 0), True).otherwise(False))
    agreed = runs.alias("r").join(ic, "name").groupBy("name").agg(F.count(F.lit(1)).alias("ic_segments"), same("ic").alias("ic_same_sign"), same("rank_ic").alias("rank_ic_same_sign"))

    # long-short returns
    first, last = F.element_at("means", 1), F.element_at("means", groups)
    ls = dates.withColumns({"ls": last - first, "long": last, "short": first})
    steps = F.transform(F.sequence(F.lit(1), F.lit(groups - 1)), lambda k: F.signum(F.element_at("means", k + 1) - F.element_at("means", k)))
    agree = F.size(F.filter(steps, lambda s: s == F.signum("ls")))
    ordered = F.array_sort("means")
    below = lambda m: F.size(F.filter("means", lambda x: x < m)) + (F.size(F.filter("means", lambda x: x == m)) + 1) / 2.0
    gap = F.aggregate(F.zip_with("means", F.sequence(F.lit(1), F.lit(groups)), lambda m, g: (below(m) - (groups + 1) / 2) * (g - (groups + 1) / 2)), F.lit(0.0), lambda a, b: a + b)
    size = F.aggregate(F.transform("means", lambda m: F.pow(below(m) - (groups + 1) / 2, F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)
    mono = F.when((F.element_at(ordered, 1) < F.element_at(ordered, groups)) & F.lit(groups >= 3), gap / F.sqrt(size * (groups * (groups**2 - 1) / 12)))
    ls = ls.withColumns({"mono": mono, "steps": F.when(F.col("ls") != 0, agree / F.lit(float(groups - 1)))})
    spent = F.avg("turnover").over(by_name)
    ls = ls.withColumn("cost", F.when(spent > 0, spent * cost).otherwise(2 * cost)).withColumn("net", F.col("ls") - F.col("cost"))
    so_far = by_name.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ls = ls.withColumns({"grown": F.product(1 + F.col("ls")).over(so_far), "grown_net": F.product(1 + F.col("net")).over(so_far)})
    ls = ls.withColumns({"fall": F.col("grown") / F.nullif(F.max("grown").over(so_far), F.lit(0.0)) - 1, "fall_net": F.col("grown_net") / F.nullif(F.max("grown_net").over(so_far), F.lit(0.0)) - 1})
    returns = ls.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_periods_returns"), F.avg("ls").alias("long_short_return"), F.avg("long").alias("long_return"), F.avg("short").alias("short_return"), F.stddev_samp("ls").alias("returns_std"),
        F.avg((F.col("ls") > 0).cast("double")).alias("win_rate"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate_after_cost"), F.avg("turnover").alias("turnover"), F.first("cost").alias("cost_per_period"),
        (F.max_by("grown", "ts") - 1).alias("total_return"), (F.max_by("grown_net", "ts") - 1).alias("total_return_after_cost"), F.min("fall").alias("max_drawdown"), F.min("fall_net").alias("max_drawdown_after_cost"),
        F.avg("mono").alias("monotonicity_mean"), F.avg(F.abs("mono")).alias("monotonicity_abs_mean"), F.avg((F.col("mono") > 0).cast("double")).alias("monotonicity_positive_ratio"),
        F.avg("steps").alias("group_mono_ratio"), F.avg((F.col("steps") == 1).cast("double")).alias("group_mono_perfect_ratio"), F.avg("fsc").alias("fsc"), F.avg("coverage").alias("avg_coverage"),
    )
    year = periods_per_year(timeframe)
    ratio = lambda x, s: F.when(F.col(s) > 0, x / F.col(s))
    net = F.col("long_short_return") - F.col("cost_per_period")
    out = sizes.join(ic, "name", "left").join(agreed, "name", "left").join(returns, "name", "left")
    return out.withColumns({
        "icir": ratio(F.col("ic_mean"), "ic_std"), "rank_icir": ratio(F.col("rank_ic_mean"), "rank_ic_std"),
        "ic_tstat": _over_sqrt(F.col("ic_mean"), F.col("ic_std"), F.col("n_periods_ic")), "rank_ic_tstat": _over_sqrt(F.col("rank_ic_mean"), F.col("rank_ic_std"), F.col("n_periods_ic")),
        "sharpe_ratio": ratio(F.col("long_short_return"), "returns_std"), "sharpe_ratio_after_cost": ratio(net, "returns_std"), "long_short_return_after_cost": net,
        "annualized_sharpe": ratio(F.col("long_short_return"), "returns_std") * year**0.5, "annualized_sharpe_after_cost": ratio(net, "returns_std") * year**0.5,
        "ic_skip_rate": 1 - F.coalesce("n_periods_ic", F.lit(0)) / F.col("n_periods"), "returns_skip_rate": 1 - F.coalesce("n_periods_returns", F.lit(0)) / F.col("n_periods"),
    })
