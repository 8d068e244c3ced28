"""Cross-sectional evaluation of factors on a panel(symbol, ts, factor, ret): ret is the return that follows."""

from __future__ import annotations

from .sqlop import SqlOp

#: bars -> panel: momentum over $n bars, known at the bar before, and the next return.
MOMENTUM_PANEL = SqlOp(
    """WITH r AS (SELECT symbol, ts, close / nullif(lag(close, $n) OVER w, 0) - 1 AS f, lead(close, 1) OVER w / nullif(close, 0) - 1 AS ret FROM #bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, f AS factor, ret FROM r WHERE f IS NOT NULL AND ret IS NOT NULL""",
    n=1,
)

_RANKED = """WITH k AS (SELECT ts, symbol, factor, ret, count(*) OVER (PARTITION BY ts) AS n,
  rank() OVER (PARTITION BY ts ORDER BY factor) + (count(*) OVER (PARTITION BY ts, factor) - 1) / CAST(2 AS DOUBLE) AS rf,
  rank() OVER (PARTITION BY ts ORDER BY ret) + (count(*) OVER (PARTITION BY ts, ret) - 1) / CAST(2 AS DOUBLE) AS rr FROM #panel),
d AS (SELECT ts, count(*) AS n, covar_samp(factor, ret) / nullif(stddev_samp(factor) * stddev_samp(ret), 0) AS ic,
  covar_samp(rf, rr) / nullif(stddev_samp(rf) * stddev_samp(rr), 0) AS rank_ic FROM k WHERE n >= $least GROUP BY ts)
"""

#: One row a date: size, Pearson and Spearman IC.
IC_SERIES = SqlOp(_RANKED + "SELECT CAST(ts AS $string) AS ts, n, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic FROM d", least=5, string="STRING")

#: IC summary over dates: mean, std, IR, t value, share of positive dates.
IC_SUMMARY = SqlOp(
    _RANKED
    + """SELECT count(*) AS dates, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(rank_ic), 6) AS rank_ic_mean, round(stddev_samp(rank_ic), 6) AS rank_ic_std,
  round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 6) AS icir, round(avg(rank_ic) / nullif(stddev_samp(rank_ic) / sqrt(count(*)), 0), 5) AS t_value,
  round(avg(CASE WHEN rank_ic > 0 THEN 1e0 ELSE 0e0 END), 6) AS positive_share, round(avg(n), 4) AS mean_size FROM d""",
    least=5,
)

_GROUPED = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY factor, symbol) AS r, count(*) OVER (PARTITION BY ts) AS n FROM #panel),
g AS (SELECT *, greatest(0, CAST(ceil((r - 1) * $groups / CAST(n - 1 AS DOUBLE)) AS INT) - 1) AS grp FROM o WHERE n >= greatest($least, 2 * $groups))
"""

#: Mean return of each quantile group and date -> over dates.
GROUP_RETURNS = SqlOp(
    _GROUPED + "SELECT grp, count(DISTINCT ts) AS dates, round(avg(m), 8) AS mean_return, round(stddev_samp(m), 8) AS std_return FROM (SELECT ts, grp, avg(ret) AS m FROM g GROUP BY ts, grp) AS x GROUP BY grp",
    groups=5,
    least=10,
)

#: Long-short spread of the outer groups by date, its running total and drawdown from the running maximum.
LONG_SHORT = SqlOp(
    _GROUPED
    + """, s AS (SELECT ts, avg(CASE WHEN grp = $groups - 1 THEN ret END) - avg(CASE WHEN grp = 0 THEN ret END) AS ls FROM g GROUP BY ts),
c AS (SELECT ts, ls, 1 + sum(ls) OVER (ORDER BY ts) AS value FROM s),
p AS (SELECT *, max(value) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM c)
SELECT count(*) AS dates, round(avg(ls), 8) AS ls_mean, round(stddev_samp(ls), 8) AS ls_std, round(avg(ls) / nullif(stddev_samp(ls), 0) * sqrt(252), 6) AS sharpe, round(sum(ls), 6) AS ls_total,
  round(min(value - peak), 6) AS max_drawdown, round(avg(CASE WHEN ls > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_share FROM p""",
    groups=5,
    least=10,
)

#: Share of the top group that was not in it on the date before.
TURNOVER = SqlOp(
    _GROUPED
    + """, t AS (SELECT symbol, ts FROM g WHERE grp = $groups - 1), d AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM (SELECT DISTINCT ts FROM t) AS q),
m AS (SELECT t.ts, d.before, CASE WHEN b.symbol IS NULL THEN 1e0 ELSE 0e0 END AS fresh FROM t JOIN d ON t.ts = d.ts LEFT JOIN t AS b ON b.ts = d.before AND b.symbol = t.symbol)
SELECT CAST(ts AS $string) AS ts, count(*) AS size, round(avg(fresh), 6) AS turnover FROM m WHERE before IS NOT NULL GROUP BY ts""",
    groups=5,
    least=10,
    string="STRING",
)

#: Rank IC against the return that many steps later, for lags 0..5: one window pass, then a row for each lag.
IC_DECAY = SqlOp(
    "WITH w AS (SELECT ts, symbol, factor, "
    + ", ".join(f"lead(ret, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS r{k}" for k in range(6))
    + " FROM #panel), e AS (SELECT *, @EXPLODE(0, 1, 2, 3, 4, 5) AS lag FROM w), l AS (SELECT ts, symbol, factor, lag, CASE lag "
    + " ".join(f"WHEN {k} THEN r{k}" for k in range(6))
    + """ END AS ret FROM e),
k2 AS (SELECT ts, lag, rank() OVER (PARTITION BY ts, lag ORDER BY factor) + (count(*) OVER (PARTITION BY ts, lag, factor) - 1) / CAST(2 AS DOUBLE) AS rf,
  rank() OVER (PARTITION BY ts, lag ORDER BY ret) + (count(*) OVER (PARTITION BY ts, lag, ret) - 1) / CAST(2 AS DOUBLE) AS rr FROM (SELECT * FROM l WHERE ret IS NOT NULL) AS x),
d AS (SELECT ts, lag, count(*) AS n, covar_samp(rf, rr) / nullif(stddev_samp(rf) * stddev_samp(rr), 0) AS ic FROM k2 GROUP BY ts, lag)
SELECT lag, count(*) AS dates, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std FROM d WHERE n >= $least GROUP BY lag""",
    least=5,
)

#: Ranks of a date scaled to [0, 1].
NORMALISE = SqlOp(
    """SELECT symbol, CAST(ts AS $string) AS ts, round((rank() OVER (PARTITION BY ts ORDER BY factor) + (count(*) OVER (PARTITION BY ts, factor) - 1) / CAST(2 AS DOUBLE) - 1)
  / nullif(count(*) OVER (PARTITION BY ts) - 1, 0), 6) AS scaled FROM #panel""",
    string="STRING",
)

#: Clip to median +- $k MAD of the symbol's values within each $secs seconds; a MAD of 0 leaves them.
CLIP_MAD = SqlOp(
    """WITH p AS (SELECT symbol, ts, factor, CAST(floor(@FLOORSECS(ts) / CAST($secs AS DOUBLE)) AS BIGINT) AS bucket FROM #panel), m AS (SELECT symbol AS ms, bucket AS mb, @PCT(factor, 0.5) AS med FROM p GROUP BY symbol, bucket),
a AS (SELECT p.*, m.med, abs(p.factor - m.med) AS dev FROM p JOIN m ON p.symbol = m.ms AND p.bucket = m.mb), b AS (SELECT symbol AS bs, bucket AS bb, @PCT(dev, 0.5) AS mad FROM a GROUP BY symbol, bucket)
SELECT a.symbol, CAST(a.ts AS $string) AS ts, round(CASE WHEN b.mad > 0 THEN least(greatest(a.factor, a.med - $k * b.mad), a.med + $k * b.mad) ELSE a.factor END, 6) AS factor FROM a JOIN b ON a.symbol = b.bs AND a.bucket = b.bb""",
    k="3.0",
    secs=604800,
    string="STRING",
)

#: Clip to the $lo and $hi quantiles of the symbol's values within each $secs seconds.
WINSORISE = SqlOp(
    """WITH p AS (SELECT symbol, ts, factor, CAST(floor(@FLOORSECS(ts) / CAST($secs AS DOUBLE)) AS BIGINT) AS bucket FROM #panel), q AS (SELECT symbol AS qs, bucket AS qb, @PCT(factor, $lo) AS lo, @PCT(factor, $hi) AS hi FROM p GROUP BY symbol, bucket)
SELECT p.symbol, CAST(p.ts AS $string) AS ts, round(least(greatest(p.factor, q.lo), q.hi), 6) AS factor FROM p JOIN q ON p.symbol = q.qs AND p.bucket = q.qb""",
    lo="0.05",
    hi="0.95",
    secs=604800,
    string="STRING",
)

#: The symbols with the largest median of the 30-bar mean turnover (10 bars at least; the plain mean for symbols of fewer than 30 bars); a share of $drop goes.
#: The ranking is over one row a symbol; equal turnovers rank by symbol, however their sums were rounded.
LIQUIDITY = SqlOp(
    """WITH t AS (SELECT symbol, close * volume AS money, avg(close * volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS turn, count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM #bars),
m AS (SELECT symbol, CASE WHEN count(*) < 30 THEN avg(money) ELSE @PCT(CASE WHEN n >= 10 THEN turn END, 0.5) END AS liquidity FROM t GROUP BY symbol), r AS (SELECT *, row_number() OVER (ORDER BY @NEAR(liquidity) DESC, symbol) AS place, count(*) OVER () AS n FROM m WHERE liquidity IS NOT NULL)
SELECT symbol, round(liquidity, 4) AS liquidity, CAST(place AS INT) AS place FROM r WHERE place <= ceil(n * (1 - $drop))""",
    drop="0.2",
)

#: Latest value of each symbol, its direction and place.
LATEST_SCAN = SqlOp(
    """WITH l AS (SELECT symbol, @MAXBY(factor, ts) AS factor FROM #panel GROUP BY symbol)
SELECT symbol, round(factor, 6) AS factor, CAST(sign(factor) AS INT) AS direction, CAST(row_number() OVER (ORDER BY factor DESC, symbol) AS INT) AS place FROM l""",
)

#: factors(symbol, ts, name, value), returns(symbol, ts, ret): composite of the factors' percent ranks with equal weights, the outer $groups-ths of each date
#: long and short, turnover as half the change of weights since the date before, and net returns.
OOS_MEASURE = SqlOp(
    """WITH k AS (SELECT ts, symbol, name, (rank() OVER (PARTITION BY ts, name ORDER BY value) + (count(*) OVER (PARTITION BY ts, name, value) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY ts, name) AS r FROM #factors),
c AS (SELECT k.ts, k.symbol, avg(k.r) AS comp, max(p.ret) AS ret FROM k JOIN #panel AS p ON k.symbol = p.symbol AND k.ts = p.ts GROUP BY k.ts, k.symbol),
o AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY round(comp, 9), symbol) AS i, count(*) OVER (PARTITION BY ts) AS n FROM c),
w AS (SELECT ts, symbol, ret, CASE WHEN i <= floor(n / CAST($groups AS DOUBLE)) THEN -1 / floor(n / CAST($groups AS DOUBLE)) WHEN i > n - floor(n / CAST($groups AS DOUBLE)) THEN 1 / floor(n / CAST($groups AS DOUBLE)) ELSE 0e0 END AS weight FROM o WHERE n >= 2 * $groups),
d AS (SELECT ts AS t, lag(ts) OVER (ORDER BY ts) AS before, lead(ts) OVER (ORDER BY ts) AS after FROM (SELECT DISTINCT ts FROM w) AS q),
x AS (SELECT t, symbol, sum(now) AS now, sum(was) AS was, sum(gain) AS gain FROM (SELECT w.ts AS t, w.symbol, w.weight AS now, 0e0 AS was, w.weight * w.ret AS gain FROM w UNION ALL SELECT d.after, w.symbol, 0e0, w.weight, 0e0 FROM w JOIN d ON w.ts = d.t WHERE d.after IS NOT NULL) AS u GROUP BY t, symbol),
y AS (SELECT t, sum(gain) AS gross, sum(abs(now - was)) / 2 AS turnover FROM x GROUP BY t)
SELECT CAST(y.t AS $string) AS ts, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - turnover * $cost, 6) AS net FROM y""",
    groups=5,
    cost="0.001",
    string="STRING",
)

#: Rank IC of each date of $least symbols or more; then mean and deviation in each of $parts runs of dates and the sign of the mean. Gates of coverage and variance are in ``cross_section``.
IC_SEGMENTS = SqlOp(
    _RANKED
    + """, s AS (SELECT rank_ic, CAST(floor((row_number() OVER (ORDER BY ts) - 1) * $parts / CAST(count(*) OVER () AS DOUBLE)) AS INT) AS part FROM d WHERE rank_ic IS NOT NULL)
SELECT part, count(*) AS dates, round(avg(rank_ic), 6) AS rank_ic_mean, round(stddev_samp(rank_ic), 6) AS rank_ic_std, CAST(sign(round(avg(rank_ic), 9)) AS INT) AS direction FROM s GROUP BY part""",
    least=5,
    parts=4,
)

#: Groups of each date by factor: mean return of each, whether means rise with the group (share of rising steps), spread of the outer ones. Costs are in ``cross_section``.
GROUP_SHAPE = SqlOp(
    _GROUPED
    + """, m AS (SELECT ts, grp, avg(ret) AS m FROM g GROUP BY ts, grp), t AS (SELECT grp, avg(m) AS m FROM m GROUP BY grp), r AS (SELECT grp, m, lag(m) OVER (ORDER BY grp) AS below FROM t)
SELECT count(*) AS groups, round(avg(CASE WHEN below IS NOT NULL THEN CASE WHEN m > below THEN 1e0 ELSE 0e0 END END), 6) AS monotonicity, round(covar_samp(grp, m) / nullif(stddev_samp(grp) * stddev_samp(m), 0), 6) AS slope_correlation,
  round(@MAXBY(m, grp) - @MINBY(m, grp), 8) AS spread FROM r""",
    groups=5,
    least=10,
)
