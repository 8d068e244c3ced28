"""Statistics of a factor against the following return, symbol by symbol: panel(symbol, ts, factor, ret)."""

from __future__ import annotations

from .sqlop import SqlOp

#: Pearson and Spearman IC, win rate, mean step, mean and deviation.
SERIES_SUMMARY = SqlOp(
    """WITH k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY factor) + (count(*) OVER (PARTITION BY symbol, factor) - 1) / CAST(2 AS DOUBLE) AS rf,
  rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / CAST(2 AS DOUBLE) AS rr, abs(factor - lag(factor) OVER (PARTITION BY symbol ORDER BY ts)) AS step FROM #panel)
SELECT symbol, count(*) AS n, round(covar_samp(factor, ret) / nullif(stddev_samp(factor) * stddev_samp(ret), 0), 6) AS ic, round(covar_samp(rf, rr) / nullif(stddev_samp(rf) * stddev_samp(rr), 0), 6) AS rank_ic,
  round(avg(CASE WHEN factor <> 0 THEN CASE WHEN sign(factor) = sign(ret) THEN 1e0 ELSE 0e0 END END), 6) AS win_rate, round(avg(step), 6) AS mean_step, round(avg(factor), 6) AS mean, round(stddev_samp(factor), 6) AS std
FROM k GROUP BY symbol HAVING count(*) >= $least""",
    least=10,
)

#: Correlation over the $n rows before each row, the row itself left out.
ROLLING_IC = SqlOp(
    """SELECT symbol, CAST(ts AS $string) AS ts, round(CASE WHEN count(ret) OVER w >= $n AND stddev_samp(factor) OVER w > 1e-10 AND stddev_samp(ret) OVER w > 1e-10
  THEN covar_samp(factor, ret) OVER w / (stddev_samp(factor) OVER w * stddev_samp(ret) OVER w) END, 6) AS ic FROM #panel WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN $n PRECEDING AND 1 PRECEDING)""",
    n=20,
    string="STRING",
)

#: Lag-k autocorrelation of the factor for k = 1..10: one window pass, then an aggregate a lag.
AUTOCORRELATION = SqlOp(
    "WITH w AS (SELECT symbol, factor, "
    + ", ".join(f"lag(factor, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS p{k}" for k in range(1, 11))
    + " FROM #panel), e AS (SELECT *, @EXPLODE(1, 2, 3, 4, 5, 6, 7, 8, 9, 10) AS lag FROM w), x AS (SELECT symbol, lag, factor, CASE lag "
    + " ".join(f"WHEN {k} THEN p{k}" for k in range(1, 11))
    + """ END AS past FROM e)
SELECT symbol, lag, round(covar_samp(factor, past) / nullif(stddev_samp(factor) * stddev_samp(past), 0), 6) AS autocorrelation FROM x WHERE past IS NOT NULL GROUP BY symbol, lag HAVING count(*) >= 10""",
)

#: Mutual information of factor and return over 10 by 10 bins of equal width, in nats.
MUTUAL_INFORMATION = SqlOp(
    """WITH e AS (SELECT symbol AS es, min(factor) AS f0, max(factor) AS f1, min(ret) AS r0, max(ret) AS r1, count(*) AS n FROM #panel GROUP BY symbol),
b AS (SELECT p.symbol, e.n, greatest(0, CAST(ceil((p.factor - e.f0) / nullif((e.f1 - e.f0) / 10, 0)) AS INT) - 1) AS x, greatest(0, CAST(ceil((p.ret - e.r0) / nullif((e.r1 - e.r0) / 10, 0)) AS INT) - 1) AS y FROM #panel AS p JOIN e ON p.symbol = e.es),
j AS (SELECT symbol, n, x, y, count(*) AS c FROM b GROUP BY symbol, n, x, y), m AS (SELECT *, sum(c) OVER (PARTITION BY symbol, x) AS cx, sum(c) OVER (PARTITION BY symbol, y) AS cy FROM j)
SELECT symbol, round(sum(c / CAST(n AS DOUBLE) * ln(c * CAST(n AS DOUBLE) / (cx * cy))), 5) AS mutual_information FROM m GROUP BY symbol""",
)

#: The statement that ``selection.correlations`` is compared with: factors(symbol, ts, name, value) -> Pearson correlation of each pair on common rows.
PAIR_CORRELATION = SqlOp(
    """SELECT a.name AS a, b.name AS b, count(*) AS n, round(covar_samp(a.value, b.value) / nullif(stddev_samp(a.value) * stddev_samp(b.value), 0), 5) AS correlation
FROM #factors AS a JOIN #factors AS b ON a.symbol = b.symbol AND a.ts = b.ts AND a.name < b.name GROUP BY a.name, b.name""",
)
