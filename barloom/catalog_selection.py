"""Queries for the association, selection and weighting of factors, with SQL written from the definitions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import Expr, col, lag, lead, or_zero, running, unless
from barloom.operators.association import feature_scores, kendall
from barloom.operators.combination import best_of_grid, greedy_combination, grid_search
from barloom.operators.rolling_weights import icir_weights, rolling_ic_matrix
from barloom.operators.spectral import principal_components
from barloom.operators.sqlop import SqlOp
from barloom.sources.bars import DUCK_BARS, event_bars

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Bars -> some factors side by side and the return of the next bar.
_WIDE = SqlOp(
    """SELECT symbol, ts, close / nullif(lag(close, 2) OVER w, 0) - 1 AS m2, close / nullif(lag(close, 5) OVER w, 0) - 1 AS m5, (high - low) / nullif(close, 0) AS span,
  lead(close) OVER w / nullif(close, 0) - 1 AS ret FROM #bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
)
_NAMES = ["m2", "m5", "span"]


def _wide(spark, sf_dir) -> DataFrame:
    return _WIDE(bars=event_bars(spark, sf_dir))


def _text(df: DataFrame, digits: int, *numbers: str) -> DataFrame:
    """ts as text and rounded numbers, as the comparison takes them."""
    return df.withColumns({"ts": F.col("ts").cast("string"), **{n: F.round(n, digits) for n in numbers}})


# ---- Kendall -------------------------------------------------------------------------------
def _kendall_ic(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    long = wide.select("symbol", "ret", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in _NAMES])).alias("f")).select("symbol", "ret", "f.name", "f.value")
    return kendall(long, ["symbol", "name"], "value", "ret").withColumn("kendall", F.round("kendall", 9))


QUERIES["kendall_ic"] = _kendall_ic
SQL["kendall_ic"] = f"""WITH w AS ({_WIDE.duck(bars=DUCK_BARS)}), l AS (SELECT symbol, ret, unnest(['m2', 'm5', 'span']) AS name, unnest([m2, m5, span]) AS value FROM w),
d AS (SELECT row_number() OVER () AS i, * FROM l WHERE value IS NOT NULL AND ret IS NOT NULL), c AS (SELECT symbol, name, count(*) AS n FROM d GROUP BY symbol, name),
p AS (SELECT a.symbol, a.name, sum(sign(a.value - b.value) * sign(a.ret - b.ret)) AS s, count(*) FILTER (a.value <> b.value) AS x, count(*) FILTER (a.ret <> b.ret) AS y FROM d AS a JOIN d AS b ON a.symbol = b.symbol AND a.name = b.name AND a.i < b.i GROUP BY a.symbol, a.name)
SELECT c.symbol, c.name, c.n, CASE WHEN c.n >= 10 THEN round(s / nullif(sqrt(CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0), 9) END AS kendall FROM c LEFT JOIN p ON c.symbol = p.symbol AND c.name = p.name"""


# ---- scores of features ----------------------------------------------------------------------
def _feature_scores(spark, sf_dir):
    found = feature_scores(_wide(spark, sf_dir), ["symbol"], _NAMES, "ret")
    return found.withColumns({"f_score": F.round("f_score", 5), "mutual_information": F.round("mutual_information", 5)})


QUERIES["feature_scores"] = _feature_scores
SQL["feature_scores"] = f"""WITH w AS ({_WIDE.duck(bars=DUCK_BARS)}), l AS (SELECT symbol, coalesce(ret, 0) AS t, unnest(['m2', 'm5', 'span']) AS feature, unnest([coalesce(m2, 0), coalesce(m5, 0), coalesce(span, 0)]) AS v FROM w),
s AS (SELECT symbol, feature, count(*) AS n, covar_pop(v, t) / nullif(stddev_pop(v) * stddev_pop(t), 0) AS c, stddev_pop(v) AS sv, stddev_pop(t) AS st FROM l GROUP BY symbol, feature),
p AS (SELECT row_number() OVER () AS i, symbol, feature, CAST(round(v / sv * 1000000000) AS BIGINT) AS x, CAST(round(t / st * 1000000000) AS BIGINT) AS y FROM l JOIN s USING (symbol, feature) WHERE sv > 0 AND st > 0 AND n > 3),
d AS (SELECT a.symbol, a.feature, a.i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM p AS a JOIN p AS b ON a.symbol = b.symbol AND a.feature = b.feature AND a.i <> b.i),
r AS (SELECT i, min(greatest(dx, dy), 3)[3] AS r FROM d GROUP BY i), q AS (SELECT symbol, feature, i, 1 + count(*) FILTER (dx <= greatest(r - 1, 0)) AS nx, 1 + count(*) FILTER (dy <= greatest(r - 1, 0)) AS ny FROM d JOIN r USING (i) GROUP BY symbol, feature, i),
h AS (SELECT k AS n, coalesce(sum(1e0 / (k - 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 0) - 0.5772156649015329 AS psi FROM (SELECT unnest(generate_series(1, (SELECT max(n) FROM s))) AS k) AS g WHERE k > 1 UNION ALL SELECT 1, -0.5772156649015329),
m AS (SELECT symbol, feature, avg(a.psi + b.psi) AS psi FROM q JOIN h AS a ON a.n = nx JOIN h AS b ON b.n = ny GROUP BY symbol, feature)
SELECT s.symbol, s.feature, s.n, CASE WHEN c * c < 1 THEN round(c * c / (1 - c * c) * (s.n - 2), 5) END AS f_score, CASE WHEN m.psi IS NOT NULL THEN round(greatest(a.psi + b.psi - m.psi, 0), 5) END AS mutual_information
FROM s JOIN h AS a ON a.n = s.n JOIN h AS b ON b.n = 3 LEFT JOIN m ON m.symbol = s.symbol AND m.feature = s.feature"""


# ---- principal components ------------------------------------------------------------------
_WINDOWS = (5, 10, 20, 50)


def pca_features(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """The return, and mean close, deviation of returns, momentum and relative volume over four windows; deviations and means need a whole window."""
    w = "PARTITION BY symbol ORDER BY ts"
    bars = bars.selectExpr("symbol", "ts", "close", "volume", f"close / nullif(lag(close) OVER ({w}), 0) - 1 AS returns", f"row_number() OVER ({w}) AS rn")
    cells, names = ["symbol", "ts", "returns"], ["returns"]
    for n in _WINDOWS:
        run = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cells += [f"CASE WHEN rn >= {n} THEN avg(close) {run} END AS sma_{n}", f"CASE WHEN count(returns) {run} >= {n} THEN stddev_samp(returns) {run} END AS vol_{n}"]
        cells += [f"close / nullif(lag(close, {n}) OVER ({w}), 0) - 1 AS momentum_{n}", f"CASE WHEN rn >= {n} THEN volume / nullif(avg(volume) {run}, 0) END AS volume_ratio_{n}"]
        names += [f"sma_{n}", f"vol_{n}", f"momentum_{n}", f"volume_ratio_{n}"]
    return bars.selectExpr(*cells), names


def _pca_components(spark, sf_dir):
    features, names = pca_features(event_bars(spark, sf_dir))
    scores, _ = principal_components(features, ["symbol"], names, 3, ["ts"])
    return _text(scores, 6, *[f"pca_component_{i}" for i in (1, 2, 3)])


def _pca_variance(spark, sf_dir):
    features, names = pca_features(event_bars(spark, sf_dir))
    _, axes = principal_components(features, ["symbol"], names, len(names), ["ts"])
    return axes.groupBy("symbol").agg(F.round(F.sum("variance"), 6).alias("variance"), F.round(F.sum(F.col("variance") * F.col("variance")), 6).alias("squares"))


QUERIES["pca_components"] = _pca_components
QUERIES["pca_variance"] = _pca_variance
_RUN = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_CELLS = [("returns", "returns")]
for _n in _WINDOWS:
    _run = _RUN.format(_n - 1)
    _CELLS += [
        (f"sma_{_n}", f"CASE WHEN rn >= {_n} THEN avg(close) {_run} END"), (f"vol_{_n}", f"CASE WHEN count(returns) {_run} >= {_n} THEN stddev_samp(returns) {_run} END"),
        (f"momentum_{_n}", f"close / nullif(lag(close, {_n}) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1"), (f"volume_ratio_{_n}", f"CASE WHEN rn >= {_n} THEN volume / nullif(avg(volume) {_run}, 0) END"),
    ]
#: The eigenvalues' sum is the number of columns that vary, times n / (n - 1); the sum of their squares that of all squared correlations.
SQL["pca_variance"] = f"""WITH b AS ({DUCK_BARS}), r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS returns, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM b),
f AS (SELECT symbol, ts, {", ".join(f"coalesce({x}, 0) AS {n}" for n, x in _CELLS)} FROM r), l AS (UNPIVOT f ON {", ".join(n for n, _ in _CELLS)} INTO NAME name VALUE v),
c AS (SELECT a.symbol, a.name AS x, b.name AS y, count(*) AS n, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS c FROM l AS a JOIN l AS b ON a.symbol = b.symbol AND a.ts = b.ts GROUP BY a.symbol, a.name, b.name)
SELECT symbol, round(coalesce(sum(CASE WHEN x = y THEN c END), 0) * max(n) / (max(n) - 1), 6) AS variance, round(coalesce(sum(c * c), 0) * pow(max(n) / (max(n) - 1e0), 2), 6) AS squares FROM c GROUP BY symbol HAVING max(n) > 1"""


# ---- rolling correlations and weights for every date -------------------------------------------
def _ic_matrix(spark, sf_dir):
    return _text(rolling_ic_matrix(_wide(spark, sf_dir), _NAMES), 8, *_NAMES)


def _icir_weights(spark, sf_dir):
    return _text(icir_weights(rolling_ic_matrix(_wide(spark, sf_dir), _NAMES), _NAMES), 5, *_NAMES)


QUERIES["rolling_ic_matrix"] = _ic_matrix
QUERIES["icir_weights"] = _icir_weights
_ROLLED = (
    f"w AS ({_WIDE.duck(bars=DUCK_BARS)}), a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM w WHERE ret IS NOT NULL AND (m2 IS NOT NULL OR m5 IS NOT NULL OR span IS NOT NULL)), "
    + "i AS (SELECT symbol, ts, rn, n, " + ", ".join(f"CASE WHEN stddev_samp({c}) OVER r * stddev_samp(CASE WHEN {c} IS NOT NULL THEN ret END) OVER r > 1e-14 THEN covar_samp({c}, ret) OVER r / (stddev_samp({c}) OVER r * stddev_samp(CASE WHEN {c} IS NOT NULL THEN ret END) OVER r) END AS {c}" for c in _NAMES)
    + " FROM a WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), "
    + "k AS (SELECT * FROM i WHERE rn >= 20 AND n >= 60 AND coalesce(m2, m5, span) IS NOT NULL), ic AS (SELECT symbol, ts, " + ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY symbol), 0) AS {c}" for c in _NAMES) + " FROM k)"
)
SQL["rolling_ic_matrix"] = f"WITH {_ROLLED} SELECT symbol, CAST(ts AS VARCHAR) AS ts, " + ", ".join(f"round({c}, 8) AS {c}" for c in _NAMES) + " FROM ic"


def solved_three(keys: str) -> str:
    """CTEs from c(keys, n, u1..u3, c11..c33, fourth) to o(keys, n, w1..w3): Ledoit-Wolf shrinkage, a ridge of 1e-6, and the solution by determinants."""
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    at = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    total = " + ".join(f"{1 if i == j else 2} * pow(c{i}{j}, 2)" for i, j in pairs)
    apart = " + ".join(f"{1 if i == j else 2} * pow(c{i}{j}{' - level' if i == j else ''}, 2)" for i, j in pairs)
    share = f"e AS (SELECT *, (c11 + c22 + c33) / 3 AS level, {total} AS total FROM c), f AS (SELECT *, ({apart}) / 3 AS apart, (fourth - total) / (3 * n) AS error FROM e), g AS (SELECT *, CASE WHEN apart > 0 THEN least(greatest(error, 0), apart) / apart ELSE 0 END AS share FROM f)"
    shrunk = f"h AS (SELECT {keys}, n, u1, u2, u3, " + ", ".join(f"(1 - share) * c{i}{j}{' + share * level + 1e-6' if i == j else ''} AS s{i}{j}" for i, j in pairs) + " FROM g)"

    def det(column: int) -> str:
        cell = lambda i, j: f"u{i}" if j == column else at(i, j)
        return " + ".join(f"{cell(1, a)} * ({cell(2, b)} * {cell(3, c)} - {cell(2, c)} * {cell(3, b)})" for a, b, c in ((1, 2, 3), (2, 3, 1), (3, 1, 2)))

    return f"{share}, {shrunk}, o AS (SELECT {keys}, n, " + ", ".join(f"({det(i)}) / ({det(0)}) AS w{i}" for i in (1, 2, 3)) + " FROM h)"


def moments_three(dev: list[str]) -> str:
    """Cells c11..c33 and fourth of deviations from the mean."""
    size = " + ".join(f"pow({d}, 2)" for d in dev)
    return ", ".join(f"avg({dev[i]} * {dev[j]}) AS c{i + 1}{j + 1}" for i in range(3) for j in range(i, 3)) + f", avg(pow({size}, 2)) AS fourth"


_MEANS = ", ".join(f"avg({c}) OVER u AS u{i + 1}" for i, c in enumerate(_NAMES))
_PARTS = ", ".join(f"round(CASE WHEN n < 2 OR abs(w1) + abs(w2) + abs(w3) = 0 THEN 1e0 / 3 ELSE w{i + 1} / (abs(w1) + abs(w2) + abs(w3)) END, 5) AS {c}" for i, c in enumerate(_NAMES))
SQL["icir_weights"] = f"""WITH {_ROLLED}, z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM ic), m AS (SELECT symbol, ts, n, {_MEANS} FROM z WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
c AS (SELECT m.symbol, m.ts, m.n, m.u1, m.u2, m.u3, {moments_three([f"(z.{c} - m.u{i + 1})" for i, c in enumerate(_NAMES)])} FROM m JOIN z ON z.symbol = m.symbol AND z.ts <= m.ts GROUP BY ALL), {solved_three("symbol, ts")}
SELECT symbol, CAST(ts AS VARCHAR) AS ts, n, {_PARTS} FROM o"""


# ---- combinations and parameters ---------------------------------------------------------------
def _greedy(spark, sf_dir):
    return greedy_combination(_wide(spark, sf_dir), ["symbol"], _NAMES, most=3).withColumn("score", F.round("score", 8))


def distance_to_mean(window: int) -> Expr:
    """Close over its mean of the last rows, less 1: the mean from two running sums, so its cost does not grow with the window."""
    close = col("close")
    total = running(close)
    return unless(close / ((total - or_zero(lag(total, window))) / float(window)) - 1.0, lag(close, window - 1))


_GRID = [{"window": w} for w in range(2, 102)]
_NEXT = lead(col("close"), 1) / col("close") - 1.0


def _grid(spark, sf_dir, metric):
    scores = grid_search(event_bars(spark, sf_dir), _NEXT, distance_to_mean, _GRID, metric)
    return scores.select("symbol", (F.col("place") + 2).alias("window"), F.round("score", 7).alias("score"))


def _grid_best(spark, sf_dir):
    best = best_of_grid(grid_search(event_bars(spark, sf_dir), _NEXT, distance_to_mean, _GRID, "effectiveness_score").withColumn("score", F.round("score", 9)))
    return best.select("symbol", (F.col("place") + 2).alias("window"), "score")


QUERIES |= {"greedy_combination": _greedy, "grid_ic": partial(_grid, metric="ic"), "grid_ir": partial(_grid, metric="ir"), "grid_best": _grid_best}


def _step_sql(step: int) -> str:
    """One step: every name that is not chosen yet, with the mean over the chosen names and itself."""
    before = f"g{step - 1}" if step > 1 else "(SELECT DISTINCT symbol, CAST([] AS VARCHAR[]) AS chosen FROM w)"
    return f"""t{step} AS (SELECT w.symbol, p.chosen, c.name, c.i, ret, list_transform(list_append(p.chosen, c.name), lambda x: v[x]) AS cells FROM w JOIN {before} AS p ON p.symbol = w.symbol JOIN (VALUES ('m2', 0), ('m5', 1), ('span', 2)) AS c(name, i) ON NOT list_contains(p.chosen, c.name) WHERE ret IS NOT NULL),
k{step} AS (SELECT symbol, chosen, name, i, ret, list_avg(cells) AS x FROM t{step} WHERE len(list_filter(cells, lambda x: x IS NOT NULL)) >= greatest(1, {step} // 2)),
s{step} AS (SELECT symbol, chosen, name, i, (abs(covar_samp(x, ret) / nullif(stddev_samp(x) * stddev_samp(ret), 0)) + coalesce(count(*) FILTER (x <> 0 AND ret <> 0 AND sign(x) = sign(ret)) / CAST(nullif(count(*) FILTER (x <> 0 AND ret <> 0), 0) AS DOUBLE), 0.5)) / 2 AS score FROM k{step} GROUP BY symbol, chosen, name, i HAVING count(*) >= 10),
g{step} AS (SELECT symbol, list_append(chosen, name) AS chosen, name, score FROM s{step} WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, i) = 1)"""


SQL["greedy_combination"] = f"WITH w AS (SELECT symbol, ret, MAP {{'m2': m2, 'm5': m5, 'span': span}} AS v FROM ({_WIDE.duck(bars=DUCK_BARS)}) AS q), {', '.join(_step_sql(s) for s in (1, 2, 3))} " + " UNION ALL ".join(f"SELECT symbol, {s} AS step, name, round(score, 8) AS score FROM g{s}" for s in (1, 2, 3))
_GRID_SQL = f"""b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS ret FROM ({DUCK_BARS}) AS q), g AS (SELECT unnest(generate_series(2, 101)) AS w),
f AS (SELECT a.symbol, a.rn, g.w, max(a.ret) AS ret, max(a.close) / nullif(avg(c.close), 0) - 1 AS x FROM g JOIN b AS a ON a.rn >= g.w AND a.ret IS NOT NULL JOIN b AS c ON c.symbol = a.symbol AND c.rn > a.rn - g.w AND c.rn <= a.rn GROUP BY a.symbol, a.rn, g.w),
i AS (SELECT symbol, w, count(x) AS n, CASE WHEN stddev_samp(x) * stddev_samp(ret) > 1e-14 THEN covar_samp(x, ret) / (stddev_samp(x) * stddev_samp(ret)) END AS ic, coalesce(count(*) FILTER (x <> 0 AND ret <> 0 AND sign(x) = sign(ret)) / CAST(nullif(count(*) FILTER (x <> 0 AND ret <> 0), 0) AS DOUBLE), 0.5) AS wins FROM f GROUP BY symbol, w)"""
_EVERY = "(SELECT DISTINCT symbol FROM b WHERE ret IS NOT NULL) AS s, g"
SQL["grid_ic"] = f"WITH {_GRID_SQL} SELECT s.symbol, CAST(g.w AS INT) AS \"window\", CASE WHEN n >= 10 THEN round(ic, 7) END AS score FROM {_EVERY} LEFT JOIN i ON i.symbol = s.symbol AND i.w = g.w"
SQL["grid_ir"] = f"""WITH {_GRID_SQL}, r AS (SELECT symbol, w, CASE WHEN count(*) OVER k >= 20 AND stddev_samp(x) OVER k * stddev_samp(ret) OVER k > 1e-14 THEN covar_samp(x, ret) OVER k / (stddev_samp(x) OVER k * stddev_samp(ret) OVER k) END AS c FROM f WHERE x IS NOT NULL WINDOW k AS (PARTITION BY symbol, w ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
d AS (SELECT symbol, w, stddev_samp(c) AS sd FROM r GROUP BY symbol, w) SELECT i.symbol, CAST(i.w AS INT) AS "window", CASE WHEN n >= 10 THEN round(CASE WHEN sd > 0 THEN ic / sd ELSE 0 END, 7) END AS score FROM i JOIN d ON d.symbol = i.symbol AND d.w = i.w"""
SQL["grid_best"] = f"WITH {_GRID_SQL} SELECT symbol, CAST(w AS INT) AS \"window\", round((abs(ic) + wins) / 2, 9) AS score FROM i WHERE n >= 10 AND ic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round((abs(ic) + wins) / 2, 9) DESC, w) = 1"
