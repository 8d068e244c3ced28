"""Factor expressions over bars, and their staged evaluation.

An expression is a small tree. Windows cannot be nested in one projection, so each window node gets the stage after
its arguments' last one; equal nodes are computed once for all requested factors, and all windows of a stage share
one partitioning and order, hence one sort. Exponential means run per symbol in pandas, since Spark has no recursion over rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
#: Moves values off exact rounding ties, which two engines may break either way.
NUDGE = 1 + 1e-10
_OVER = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {lo} AND {hi})"


class Expr:
    """kind: col, num, fn (template over arguments), win (aggregate over a frame), ewm."""

    def __init__(self, kind: str, text, args: tuple = (), frame: tuple | str | None = None, duck: str | None = None):
        self.kind, self.text, self.args, self.frame, self.duck = kind, text, args, frame, duck or text
        self.level = max((a.level for a in args), default=0) + (kind in ("win", "ewm"))
        self.key = f"{kind}:{text}:{frame}:({','.join(a.key for a in args)})"

    def _two(self, other, template):
        return fn(template, self, other)

    def __add__(self, o):
        return self._two(o, "({0} + {1})")

    def __radd__(self, o):
        return lift(o) + self

    def __sub__(self, o):
        return self._two(o, "({0} - {1})")

    def __rsub__(self, o):
        return lift(o) - self

    def __mul__(self, o):
        return self._two(o, "({0} * {1})")

    def __rmul__(self, o):
        return lift(o) * self

    def __truediv__(self, o):
        return self._two(o, "({0} / nullif({1}, 0))")

    def __rtruediv__(self, o):
        return lift(o) / self

    def __neg__(self):
        return fn("(-{0})", self)

    def __lt__(self, o):
        return self._two(o, "coalesce({0} < {1}, false)")

    def __le__(self, o):
        return self._two(o, "coalesce({0} <= {1}, false)")

    def __gt__(self, o):
        return self._two(o, "coalesce({0} > {1}, false)")

    def __ge__(self, o):
        return self._two(o, "coalesce({0} >= {1}, false)")

    def __and__(self, o):
        return self._two(o, "({0} AND {1})")

    def sql(self, names: dict[str, str], duck: bool = False) -> str:
        if self.key in names:
            return names[self.key]
        if self.kind == "col":
            return self.text
        if self.kind == "num":
            return f"CAST({self.text!r} AS DOUBLE)"
        inner = (self.duck if duck else self.text).format(*[a.sql(names, duck) for a in self.args])
        if self.kind == "win" and isinstance(self.frame, str):
            return f"{inner} OVER ({self.frame.format(*[a.sql(names, duck) for a in self.args])})"
        if self.kind == "win":
            lo, hi = (("UNBOUNDED PRECEDING" if x is None and i == 0 else "UNBOUNDED FOLLOWING" if x is None else "CURRENT ROW" if x == 0 else f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING") for i, x in enumerate(self.frame))
            return f"{inner} {_OVER.format(lo=lo, hi=hi)}"
        return inner


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Expr("num", float(x))


def col(name: str) -> Expr:
    return Expr("col", name)


def fn(template: str, *args, duck: str | None = None) -> Expr:
    return Expr("fn", template, tuple(map(lift, args)), duck=duck)


def win(template: str, *args, frame: tuple | str, duck: str | None = None) -> Expr:
    return Expr("win", template, tuple(map(lift, args)), frame, duck)


# ---- building blocks -----------------------------------------------------------


def roll(aggregate: str, x, n: int, least: int | None = None, duck: str | None = None) -> Expr:
    """Aggregate over the last n rows; null with fewer than ``least`` (default n) values."""
    frame = (-(n - 1), 0)
    return fn("CASE WHEN {0} >= %d THEN {1} END" % (n if least is None else least), win("count({0})", x, frame=frame), win(aggregate, x, frame=frame, duck=duck))


def lag(x, k: int = 1) -> Expr:
    return lift(x) if k == 0 else win("max({0})", x, frame=(-k, -k))


def lead(x, k: int = 1) -> Expr:
    return win("max({0})", x, frame=(k, k))


def delta(x, k: int = 1) -> Expr:
    return lift(x) - lag(x, k)


def pct(x, k: int = 1) -> Expr:
    return lift(x) / lag(x, k) - 1.0


def mean(x, n, least=None):
    return roll("avg({0})", x, n, least)


def std(x, n, least=None):
    return roll("stddev_samp({0})", x, n, max(2, n if least is None else least))


def total(x, n, least=None):
    return roll("sum({0})", x, n, least)


def high_of(x, n, least=None):
    return roll("max({0})", x, n, least)


def low_of(x, n, least=None):
    return roll("min({0})", x, n, least)


def quantile(x, n, q, least=None):
    return roll("percentile({0}, %r)" % q, x, n, least, duck="quantile_cont({0}, %r)" % q)


def values(x, n) -> Expr:
    return win("collect_list({0})", x, frame=(-(n - 1), 0), duck="list({0}) FILTER ({0} IS NOT NULL)")


def rank_of_last(x, n, least=None) -> Expr:
    """Average-tie percent rank of the last value in its window."""
    x = lift(x)
    below = "(size(filter({1}, v -> v < {2})) + (size(filter({1}, v -> v = {2})) + 1) / 2.0D) / size({1})"
    duck = "(len(list_filter({1}, lambda v: v < {2})) + (len(list_filter({1}, lambda v: v = {2})) + 1) / 2.0) / len({1})"
    least = n if least is None else least
    guard = "CASE WHEN {0} >= %d AND {2} IS NOT NULL THEN " % least
    return fn(guard + below + " END", win("count({0})", x, frame=(-(n - 1), 0)), values(x, n), x, duck=guard + duck + " END")


def place_of(which: str, x, n, least=None) -> Expr:
    """1-based position, oldest first, of the first max or min in the window."""
    least = n if least is None else least
    guard = "CASE WHEN {0} >= %d THEN " % least
    top = win(which + "({0})", x, frame=(-(n - 1), 0))
    return fn(guard + "CAST(array_position({1}, {2}) AS DOUBLE) END", win("count({0})", x, frame=(-(n - 1), 0)), values(x, n), top, duck=guard + "CAST(list_position({1}, {2}) AS DOUBLE) END")


def corr(a, b, n, least=None) -> Expr:
    """Rolling Pearson over rows where both are known; null where either is constant."""
    a, b = both(a, b)
    least = max(2, n if least is None else least)
    frame = (-(n - 1), 0)
    sd = [win("stddev_samp({0})", x, frame=frame) for x in (a, b)]
    return fn("CASE WHEN {0} >= %d AND {2} > 1e-10 AND {3} > 1e-10 THEN {1} / ({2} * {3}) END" % least, win("count({0})", a, frame=frame), win("covar_samp({0}, {1})", a, b, frame=frame), *sd)


def both(a, b) -> tuple[Expr, Expr]:
    a, b = lift(a), lift(b)
    return fn("CASE WHEN {1} IS NOT NULL THEN {0} END", a, b), fn("CASE WHEN {1} IS NOT NULL THEN {0} END", b, a)


def cov(a, b, n, least=None) -> Expr:
    a, b = both(a, b)
    frame = (-(n - 1), 0)
    return fn("CASE WHEN {0} >= %d THEN {1} END" % max(2, n if least is None else least), win("count({0})", a, frame=frame), win("covar_samp({0}, {1})", a, b, frame=frame))


RN = col("rn")


def slope(y, n) -> Expr:
    frame = (-(n - 1), 0)
    return fn("CASE WHEN {0} = %d THEN {1} / %r END" % (n, n * (n + 1) / 12.0), win("count({0})", y, frame=frame), win("covar_samp({0}, {1})", y, RN, frame=frame))


def fit_r2(y, n) -> Expr:
    r = corr(y, RN, n)
    return r * r


def fit_residual(y, n) -> Expr:
    return lift(y) - mean(y, n) - slope(y, n) * ((n - 1) / 2.0)


def weighted(x, n, weights: list[float]) -> Expr:
    """Sum of weights times lags (weights[0] for the newest); null unless all n values are known."""
    out = lift(x) * weights[0]
    for k in range(1, n):
        out = out + lag(x, k) * weights[k]
    return out


def decay_linear(x, n) -> Expr:
    whole = n * (n + 1) / 2.0
    return weighted(x, n, [(n - k) / whole for k in range(n)])


def running(x) -> Expr:
    return win("sum({0})", x, frame=(None, 0))


def whole(aggregate: str, x, duck: str | None = None) -> Expr:
    """Aggregate over the symbol's whole history (looks ahead)."""
    return win(aggregate, x, frame=(None, None), duck=duck)


def last_known(x) -> Expr:
    return win("last({0}, true)", x, frame=(None, 0), duck="last_value({0} IGNORE NULLS)")


def skew(x, n, least=None) -> Expr:
    """Population skewness."""
    n_of = win("count({0})", x, frame=(-(n - 1), 0))
    spark = win("skewness({0})", x, frame=(-(n - 1), 0))
    body = "CASE WHEN {0} >= %d AND {2} > 1e-10 THEN {1} END" % max(3, n if least is None else least)
    alt = "CASE WHEN {0} >= %d AND {2} > 1e-10 THEN {1} * ({0} - 2) / sqrt({0} * ({0} - 1.0)) END" % max(3, n if least is None else least)
    return fn(body, n_of, spark, win("stddev_samp({0})", x, frame=(-(n - 1), 0)), duck=alt)


def kurt(x, n, least=None) -> Expr:
    """Population excess kurtosis."""
    frame = (-(n - 1), 0)
    body = "CASE WHEN {0} >= %d AND {2} > 1e-10 THEN {1} END" % max(4, n if least is None else least)
    return fn(body, win("count({0})", x, frame=frame), win("kurtosis({0})", x, frame=frame, duck="kurtosis_pop({0})"), win("stddev_samp({0})", x, frame=frame))


def ewm(x, span: float | None = None, alpha: float | None = None, adjust: bool = True) -> Expr:
    alpha = 2.0 / (span + 1.0) if alpha is None else alpha
    return Expr("ewm", (alpha, adjust), (lift(x),))


def when(cond: Expr, a, b) -> Expr:
    return fn("CASE WHEN {0} THEN {1} ELSE {2} END", cond, a, b)


def flag(cond: Expr) -> Expr:
    return fn("CASE WHEN {0} THEN 1.0D ELSE 0.0D END", cond, duck="CASE WHEN {0} THEN 1.0 ELSE 0.0 END")


def absolute(x):
    return fn("abs({0})", x)


def sign(x):
    return fn("CAST(sign({0}) AS DOUBLE)", x)


def ln(x):
    return fn("CASE WHEN {0} > 0 THEN ln({0}) END", x)


def sqrt(x):
    return fn("CASE WHEN {0} >= 0 THEN sqrt({0}) END", x)


def power(x, p: float):
    return fn("pow({0}, %r)" % float(p), x)


def larger(*xs):
    return fn("greatest(" + ", ".join(f"{{{i}}}" for i in range(len(xs))) + ")", *xs)


def smaller(*xs):
    return fn("least(" + ", ".join(f"{{{i}}}" for i in range(len(xs))) + ")", *xs)


def or_zero(x):
    return fn("coalesce({0}, 0.0D)", x, duck="coalesce({0}, 0.0)")


def unless(x, y):
    """null where y is null, else x"""
    return fn("CASE WHEN {1} IS NOT NULL THEN {0} END", x, y)


# ---- evaluation ------------------------------------------------------------------


def _stages(roots: Iterable[Expr]) -> tuple[dict[str, str], list[list[Expr]]]:
    names: dict[str, str] = {}
    stages: list[list[Expr]] = []

    def visit(e: Expr) -> None:
        if e.kind in ("win", "ewm") and e.key in names:
            return
        for a in e.args:
            visit(a)
        if e.kind in ("win", "ewm"):
            names[e.key] = f"_w{len(names)}"
            while len(stages) < e.level:
                stages.append([])
            stages[e.level - 1].append(e)

    for root in roots:
        visit(root)
    return names, stages


def evaluate(bars: DataFrame, factors: dict[str, Expr]) -> DataFrame:
    """bars(symbol, ts, ...) -> symbol, ts and a column for each factor, in full precision; infinite and NaN values are null."""
    names, stages = _stages(factors.values())
    out = bars.selectExpr("*", "row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn")
    for stage in stages:
        sql = [e for e in stage if e.kind == "win"]
        if sql:
            hidden = {k: v for k, v in names.items() if k not in {e.key for e in sql}}
            out = out.selectExpr("*", *[f"{e.sql(hidden)} AS {names[e.key]}" for e in sql])
        means = [e for e in stage if e.kind == "ewm"]
        if means:
            out = _smoothed(out, means, names)
    cells = [f"{e.sql(names)} AS `{name}`" for name, e in factors.items()]
    out = out.selectExpr("symbol", "ts", *cells)
    finite = [F.when(F.abs(F.col(f"`{n}`").cast("double")) < float("inf"), F.col(f"`{n}`").cast("double")).alias(n) for n in factors]
    return out.select("symbol", "ts", *finite)


def rounded(values: DataFrame, digits: int = 4) -> DataFrame:
    """symbol, ts and factor columns as the comparison with ``duckdb_sql`` takes them: rounded to decimals and to five digits more before the point, ts as text."""

    def shown(n: str):
        x = F.col(f"`{n}`") * NUDGE
        unit = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.greatest(F.abs(x), F.lit(1.0)))) - 4, F.lit(0)).cast("double"))
        return (F.round(x / unit, digits) * unit).alias(n)

    return values.select("symbol", F.col("ts").cast("string").alias("ts"), *[shown(n) for n in values.columns[2:]])


def _smoothed(df: DataFrame, means: list[Expr], names: dict[str, str]) -> DataFrame:
    args = {names[e.key]: e for e in means}
    df = df.selectExpr("*", *[f"CAST({e.args[0].sql(names)} AS DOUBLE) AS in{name}" for name, e in args.items()])
    specs = {name: e.text for name, e in args.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        for name, (alpha, adjust) in specs.items():
            pdf[name] = pdf.pop(f"in{name}").ewm(alpha=alpha, adjust=adjust).mean()
        return pdf

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if not f.name.startswith("in_w")]
    schema = ", ".join([*kinds, *[f"{name} double" for name in args]])
    return df.groupBy("symbol").applyInPandas(run, schema)


def duckdb_sql(bars_sql: str, factors: dict[str, Expr], digits: int = 4) -> str:
    """The same evaluation as DuckDB SQL; exponential means in closed form (for histories whose weights stay within doubles)."""
    names, stages = _stages(factors.values())
    steps = [f"b AS ({bars_sql})", "s0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM b)"]
    at = "s0"
    for stage in stages:
        hidden = {k: v for k, v in names.items() if k not in {e.key for e in stage}}
        cells = []
        for e in stage:
            if e.kind == "win":
                cells.append(f"{e.sql(hidden, True)} AS {names[e.key]}")
            else:
                (alpha, adjust), x, q = e.text, e.args[0].sql(hidden, True), 1.0 - e.text[0]
                over = _OVER.format(lo="UNBOUNDED PRECEDING", hi="CURRENT ROW")
                up = f"sum({x} * pow({q!r}, -rn)) {over}"
                if adjust:
                    cells.append(f"{up} / nullif(sum(CASE WHEN {x} IS NOT NULL THEN pow({q!r}, -rn) END) {over}, 0) AS {names[e.key]}")
                else:
                    first = f"(first_value({x} IGNORE NULLS) {over}) * pow({q!r}, -(min(CASE WHEN {x} IS NOT NULL THEN rn END) {over}))"
                    cells.append(f"pow({q!r}, rn) * ({alpha!r} * ({up}) + {q!r} * {first}) AS {names[e.key]}")
        new = f"s{len(steps) - 1}"
        steps.append(f"{new} AS (SELECT *, {', '.join(cells)} FROM {at})")
        at = new
    raw = [f'CAST({e.sql(names, True)} AS DOUBLE) * {NUDGE!r} AS "{n}"' for n, e in factors.items()]
    steps.append(f"raw AS (SELECT symbol, ts, {', '.join(raw)} FROM {at})")
    unit = "pow(10, greatest(floor(log10(greatest(abs({0}), 1))) - 4, 0))"
    out = [f'CASE WHEN isfinite({c}) THEN round({c} / {unit.format(c)}, {digits}) * {unit.format(c)} END AS {c}' for c in (f'"{n}"' for n in factors)]
    return f"WITH {', '.join(steps)} SELECT symbol, CAST(ts AS VARCHAR) AS ts, {', '.join(out)} FROM raw"
