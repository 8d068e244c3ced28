"""Full evaluation of many factors at once: scored(symbol, ts, name, value, ret), ret being the return that ends at ts.

A factor is judged by its value one bar earlier, as in trading. Everything is grouped by (symbol, name), so any number of factors
and symbols is one job; windows are partitioned by both.
"""

from __future__ import annotations

from .sqlop import SqlOp

_BY = "PARTITION BY symbol, name ORDER BY ts"
_LAGS = range(6)


def corr(a: str, b: str) -> str:
    """Pearson correlation over the rows that have both; null below 10 rows or without variance."""
    only = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN"
    return f"CASE WHEN count({only} 1 END) >= 10 THEN covar_samp({a}, {b}) / nullif(stddev_samp({only} {a} END) * stddev_samp({only} {b} END), 0) END"


def skewness(x: str) -> str:
    return f"CASE WHEN count({x}) > 2 THEN sqrt(CAST(count({x}) * (count({x}) - 1) AS DOUBLE)) / (count({x}) - 2) * (avg({x} * {x} * {x}) - 3 * avg({x}) * avg({x} * {x}) + 2 * pow(avg({x}), 3)) / nullif(pow(var_pop({x}), 1.5), 0) END"


def kurtosis(x: str) -> str:
    fourth = f"(avg({x} * {x} * {x} * {x}) - 4 * avg({x}) * avg({x} * {x} * {x}) + 6 * pow(avg({x}), 2) * avg({x} * {x}) - 3 * pow(avg({x}), 4))"
    return f"CASE WHEN count({x}) > 3 THEN (count({x}) - 1) / CAST((count({x}) - 2) * (count({x}) - 3) AS DOUBLE) * ((count({x}) + 1) * ({fourth} / nullif(pow(var_pop({x}), 2), 0) - 3) + 6) END"


_SHIFTED = (
    f"WITH a AS (SELECT symbol, name, ts, ret, lag(value) OVER ({_BY}) AS x, "
    + ", ".join(f"lag(ret, {k}) OVER ({_BY}) AS r{k}" for k in _LAGS if k)
    + f""", ret AS r0 FROM #scored), s AS (SELECT *, abs(x - lag(x) OVER ({_BY})) AS step, lag(x, 1) OVER ({_BY}) AS x1, lag(x, 5) OVER ({_BY}) AS x5 FROM a),
t AS (SELECT *, CASE WHEN count(step) OVER w = 20 THEN avg(step) OVER w END AS turn FROM s WINDOW w AS ({_BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
p AS (SELECT * FROM t WHERE x IS NOT NULL AND ret IS NOT NULL),
"""
)
_MEASURES = (
    "g AS (SELECT symbol, name, count(x) AS data_length, avg(CASE WHEN x IS NULL THEN 1e0 ELSE 0e0 END) AS missing_ratio, "
    + ", ".join(f"{corr('x', f'r{k}')} AS ic_lag_{k}" for k in _LAGS)
    + f""", {skewness("x")} AS skewness, {kurtosis("x")} AS kurtosis, avg(turn) AS turnover, {corr("x", "x1")} AS autocorrelation_1, {corr("x", "x5")} AS autocorrelation_5 FROM t GROUP BY symbol, name),
k AS (SELECT symbol, name, x, ret, rank() OVER (PARTITION BY symbol, name ORDER BY x) + (count(*) OVER (PARTITION BY symbol, name, x) - 1) / CAST(2 AS DOUBLE) AS rx,
  rank() OVER (PARTITION BY symbol, name ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, name, ret) - 1) / CAST(2 AS DOUBLE) AS rr FROM p),
e AS (SELECT symbol AS es, name AS en, min(x) AS x0, max(x) AS xn, min(ret) AS y0, max(ret) AS yn, count(*) AS n, @PCT(x, 0.2) AS q1, @PCT(x, 0.4) AS q2, @PCT(x, 0.6) AS q3, @PCT(x, 0.8) AS q4 FROM p GROUP BY symbol, name),
b AS (SELECT k.*, e.n, greatest(0, CAST(ceil((x - x0) / nullif((xn - x0) / 10, 0)) AS INT) - 1) AS bx, greatest(0, CAST(ceil((ret - y0) / nullif((yn - y0) / 10, 0)) AS INT) - 1) AS brr,
  CASE WHEN x <= q1 THEN 0 WHEN x <= q2 THEN 1 WHEN x <= q3 THEN 2 WHEN x <= q4 THEN 3 ELSE 4 END AS grp FROM k JOIN e ON symbol = es AND name = en),
h AS (SELECT symbol AS hs, name AS hn, {corr("rx", "rr")} AS ic_spearman, CASE WHEN count(*) >= 10 THEN avg(CASE WHEN x <> 0 THEN CASE WHEN sign(x) = sign(ret) THEN 1e0 ELSE 0e0 END END) END AS win_rate,
  CASE WHEN count(*) >= 50 THEN avg(CASE WHEN grp = 4 THEN ret END) END AS long_return, CASE WHEN count(*) >= 50 THEN avg(CASE WHEN grp = 0 THEN ret END) END AS short_return, stddev_samp(ret) AS returns_std,
  CASE WHEN count(*) >= 50 THEN avg(CASE WHEN grp = 4 THEN ret WHEN grp = 0 THEN -ret END) / nullif(stddev_samp(CASE WHEN grp = 4 THEN ret WHEN grp = 0 THEN -ret END), 0) END AS sharpe,
  CASE WHEN count(*) >= 50 THEN avg(CASE WHEN grp = 4 THEN ret WHEN grp = 0 THEN -ret ELSE 0e0 END) / nullif(stddev_samp(CASE WHEN grp = 4 THEN ret WHEN grp = 0 THEN -ret ELSE 0e0 END), 0) END AS sharpe_full FROM b GROUP BY symbol, name),
c AS (SELECT symbol, name, n, bx, brr, count(*) AS c FROM b GROUP BY symbol, name, n, bx, brr), m AS (SELECT *, sum(c) OVER (PARTITION BY symbol, name, bx) AS cx, sum(c) OVER (PARTITION BY symbol, name, brr) AS cy FROM c),
i AS (SELECT symbol AS ms, name AS mn, sum(c / CAST(n AS DOUBLE) * ln(c * CAST(n AS DOUBLE) / (cx * cy))) AS mutual_information FROM m GROUP BY symbol, name),
z AS (SELECT g.*, h.*, i.mutual_information, ic_lag_0 AS ic_pearson, (coalesce(ic_lag_0, ic_lag_1, ic_lag_2, ic_lag_3, ic_lag_4, ic_lag_5) - coalesce(ic_lag_5, ic_lag_4, ic_lag_3, ic_lag_2, ic_lag_1, ic_lag_0))
  / nullif("""
    + " + ".join(f"CASE WHEN ic_lag_{k} IS NULL THEN 0 ELSE 1 END" for k in _LAGS)
    + """, 0) AS decay_rate,
  least(abs(ic_lag_0) * 10, 1e0) * 0.4 + least(mutual_information * 5, 1e0) * 0.3 + win_rate * 0.2 + greatest(0e0, 1 - turnover) * 0.1 AS effectiveness
  FROM g JOIN h ON g.symbol = hs AND g.name = hn JOIN i ON g.symbol = ms AND g.name = mn)
"""
)
_SHOWN = ["missing_ratio", "ic_pearson", "ic_spearman", "mutual_information", "long_return", "short_return", "returns_std", "sharpe", "sharpe_full", "skewness", "kurtosis", "turnover", "win_rate", "autocorrelation_1", "autocorrelation_5", "decay_rate", *[f"ic_lag_{k}" for k in _LAGS], "effectiveness"]

#: One row a symbol and factor with every measure: data, IC at lags 0 to 5, mutual information, group returns, shape, turnover, win rate, decay, score.
FACTOR_ANALYSIS = SqlOp(_SHIFTED + _MEASURES + "SELECT symbol, name, data_length, " + ", ".join(f"round({c}, 5) AS {c}" for c in _SHOWN) + ", round(long_return - short_return, 5) AS long_short_return FROM z")

#: Factors of each symbol by falling absolute $metric, the best $top of them (a report).
FACTOR_RANKING = SqlOp(
    _SHIFTED + _MEASURES + "SELECT symbol, name, round($metric, 5) AS metric, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs($metric) DESC, name) AS place FROM z) AS r WHERE place <= $top",
    metric="ic_pearson",
    top=10,
)

_ROLLING = f"""WITH a AS (SELECT symbol, name, ts, ret, lag(value) OVER ({_BY}) AS x FROM #scored),
r AS (SELECT symbol, name, ts, row_number() OVER ({_BY}) AS i, CASE WHEN count(CASE WHEN x IS NOT NULL AND ret IS NOT NULL THEN 1 END) OVER w >= 10 AND row_number() OVER ({_BY}) > $window
  THEN covar_samp(x, ret) OVER w / nullif(stddev_samp(CASE WHEN ret IS NOT NULL THEN x END) OVER w * stddev_samp(CASE WHEN x IS NOT NULL THEN ret END) OVER w, 0) END AS ic
  FROM a WINDOW w AS ({_BY} ROWS BETWEEN $window PRECEDING AND 1 PRECEDING)),
"""

#: Information ratio of the trailing ICs (each over the $window bars before it) over the $ir bars before.
ROLLING_IR = SqlOp(
    _ROLLING + f"v AS (SELECT *, avg(ic) OVER u AS m, stddev_samp(ic) OVER u AS s, count(ic) OVER u AS n FROM r WINDOW u AS ({_BY} ROWS BETWEEN $ir PRECEDING AND 1 PRECEDING)) "
    "SELECT symbol, name, CAST(ts AS $string) AS ts, round(ic, 6) AS ic, round(CASE WHEN i > $ir AND n > 1 AND s > 1e-12 THEN m / s END, 4) AS ir FROM v",
    window=60,
    ir=20,
    string="STRING",
)

#: 1 / (1 + mean rolling standard deviation) of each factor's trailing ICs, their mean, ratio and share above 0.
IC_STABILITY = SqlOp(
    _ROLLING + f"v AS (SELECT *, CASE WHEN count(ic) OVER u = $ir THEN stddev_samp(ic) OVER u END AS s FROM r WINDOW u AS ({_BY} ROWS BETWEEN {{}} PRECEDING AND CURRENT ROW)) ".format("$last")
    + "SELECT symbol, name, round(1 / (1 + avg(s)), 6) AS stability, round(avg(ic), 6) AS ic_mean, round(avg(ic) / nullif(stddev_samp(ic), 0), 5) AS icir, round(avg(CASE WHEN ic > 0 THEN 1e0 WHEN ic IS NOT NULL THEN 0e0 END), 6) AS positive_share FROM v GROUP BY symbol, name",
    window=60,
    ir=20,
    last=19,
)

#: Mean and population deviation of a factor's IC with the one-bar returns 1..5 bars later, and the mining score of those that pass $ic and $ratio.
MINING_SCORE = SqlOp(
    f"WITH a AS (SELECT symbol, name, value AS x, " + ", ".join(f"lead(ret, {k}) OVER ({_BY}) AS f{k}" for k in range(1, 6)) + " FROM #scored), c AS (SELECT symbol, name, "  # noqa: F541
    + ", ".join(f"{corr('x', f'f{k}')} AS c{k}" for k in range(1, 6))
    + " FROM a GROUP BY symbol, name), l AS (SELECT *, @EXPLODE(1, 2, 3, 4, 5) AS h FROM c), v AS (SELECT symbol, name, CASE h " + " ".join(f"WHEN {k} THEN c{k}" for k in range(1, 6))
    + """ END AS ic FROM l), m AS (SELECT symbol, name, avg(ic) AS ic, avg(ic) / nullif(stddev_pop(ic), 0) AS ir FROM v GROUP BY symbol, name)
SELECT symbol, name, round(ic, 6) AS ic, round(ir, 4) AS ir, round(CASE WHEN abs(ic) >= $ic AND abs(ir) >= $ratio THEN 0.7 * abs(ic) + 0.3 * abs(ir) ELSE 0e0 END, 4) AS score FROM m""",
    ic="0.01",
    ratio="0.1",
)

#: Factor against the next bar's return: IC, share of bars where both percent ranks are on one side of a half, stability of the 20-bar correlation.
LIBRARY_PERFORMANCE = SqlOp(
    f"""WITH a AS (SELECT symbol, name, ts, value AS x, lead(ret) OVER ({_BY}) AS y FROM #scored), p AS (SELECT * FROM a WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, (rank() OVER (PARTITION BY symbol, name ORDER BY x) + (count(*) OVER (PARTITION BY symbol, name, x) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY symbol, name) AS px,
  (rank() OVER (PARTITION BY symbol, name ORDER BY y) + (count(*) OVER (PARTITION BY symbol, name, y) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY symbol, name) AS py,
  CASE WHEN count(*) OVER w = 20 THEN covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) END AS c FROM p WINDOW w AS ({_BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, name, count(*) AS n, round({corr("x", "y")}, 6) AS ic, round(avg(CASE WHEN (px > 0.5 AND py > 0.5) OR (px < 0.5 AND py < 0.5) THEN 1e0 ELSE 0e0 END), 6) AS win_rate, round(1 / (stddev_samp(c) + 1e-6), 4) AS stability FROM k GROUP BY symbol, name""",
)
