"""Cleaning, repairing, resampling and grading of bars and of raw rows."""

from __future__ import annotations

from .sqlop import SqlOp

#: Rows with a finite factor and return, and a factor that is not 0 where $nonzero.
VALID = SqlOp("SELECT symbol, CAST(ts AS $string) AS ts, round(factor, 6) AS factor, round(ret, 6) AS ret FROM #panel WHERE abs(factor) < 1e300 AND abs(ret) < 1e300 AND ($nonzero = 0 OR factor <> 0)", nonzero=1, string="STRING")

#: Missing prices take the last known ones; bars without volume go.
MARKET_CLEAN = SqlOp(
    """WITH f AS (SELECT symbol, ts, @IGN(open) OVER w AS open, @IGN(high) OVER w AS high, @IGN(low) OVER w AS low, @IGN(close) OVER w AS close, @IGN(volume) OVER w AS volume
  FROM #bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, CAST(ts AS $string) AS ts, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM f WHERE volume > 0""",
    string="STRING",
)

#: Missing values take the last known ones, else the next; rows with none at all go.
PREPROCESS = SqlOp(
    """WITH f AS (SELECT symbol, ts, coalesce(@IGN(open) OVER w, @FIRST(open) OVER x) AS open, coalesce(@IGN(close) OVER w, @FIRST(close) OVER x) AS close, coalesce(@IGN(basis) OVER w, @FIRST(basis) OVER x) AS basis FROM #bars
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, CAST(ts AS $string) AS ts, round(open, 4) AS open, round(close, 4) AS close, round(basis, 4) AS basis FROM f WHERE coalesce(open, close, basis) IS NOT NULL""",
    string="STRING",
)

#: Every $step-th distinct time. The numbering is over one row a time.
SAMPLE_STEP = SqlOp(
    """WITH d AS (SELECT ts AS t, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM #panel) AS q)
SELECT p.symbol, CAST(p.ts AS $string) AS ts, round(p.factor, 6) AS factor FROM #panel AS p JOIN d ON p.ts = d.t WHERE (i - 1) % $step = 0""",
    step=3,
    string="STRING",
)

#: Each symbol's bars that were complete at the latest time of all, and whether the last is fresh: no older than one bar before the bar then running.
COMPLETED = SqlOp(
    """WITH n AS (SELECT floor(max(@FLOORSECS(ts)) / CAST($secs AS DOUBLE)) * $secs AS edge FROM #bars)
SELECT symbol, count(CASE WHEN @FLOORSECS(ts) < edge THEN 1 END) AS complete, count(*) AS n, max(CASE WHEN @FLOORSECS(ts) >= edge - $secs THEN 1 ELSE 0 END) AS fresh FROM #bars JOIN n ON true GROUP BY symbol""",
    secs=14400,
)

#: Whether a symbol's bars may be used: enough rows, no empty column, high never below low.
VALIDATE = SqlOp(
    """SELECT symbol, count(*) AS n, count(open) > 0 AND count(high) > 0 AND count(low) > 0 AND count(close) > 0 AND count(volume) > 0 AS filled, count(CASE WHEN high < low THEN 1 END) AS crossed,
  count(*) >= $least AND count(open) > 0 AND count(high) > 0 AND count(low) > 0 AND count(close) > 0 AND count(volume) > 0 AND count(CASE WHEN high < low THEN 1 END) = 0 AS usable FROM #bars GROUP BY symbol""",
    least=100,
)

#: Rows equal in symbol, time and value once, by the smallest seq.
DEDUP_COLUMNS = SqlOp("SELECT symbol, CAST(ts AS $string) AS ts, round(value, 4) AS value, min(seq) AS seq FROM #extra GROUP BY symbol, ts, value", string="STRING")

#: Of rows within one second (rounded, half to even) the last by time and seq.
DEDUP_SECOND = SqlOp(
    """SELECT symbol, second, round(value, 4) AS value, seq FROM (SELECT symbol, value, seq, @ROUNDSECS(ts) AS second, row_number() OVER (PARTITION BY symbol, @ROUNDSECS(ts) ORDER BY ts DESC, seq DESC) AS k FROM #ticks) AS x WHERE k = 1"""
)

#: The three rules in turn: equal rows, then one row a second, then one row a time, in order.
DEDUP_DEEP = SqlOp(
    """WITH a AS (SELECT symbol, ts, value, min(seq) AS seq FROM #ticks GROUP BY symbol, ts, value), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, @ROUNDSECS(ts) ORDER BY ts DESC, seq DESC) AS k FROM a) AS x WHERE k = 1)
SELECT symbol, CAST(ts AS $string) AS ts, round(value, 4) AS value, seq FROM (SELECT symbol, ts, value, seq, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS j FROM b) AS y WHERE j = 1""",
    string="STRING",
)

#: New rows over stored ones: a (symbol, ts) has the new row if there is one, else the stored one.
UPSERT = SqlOp(
    """SELECT coalesce(n.symbol, o.symbol) AS symbol, CAST(coalesce(n.ts, o.ts) AS $string) AS ts, round(CASE WHEN n.symbol IS NOT NULL THEN n.value ELSE o.value END, 4) AS value,
  CASE WHEN o.symbol IS NULL THEN 'added' WHEN n.symbol IS NULL THEN 'kept' ELSE 'replaced' END AS change FROM #stored AS o FULL OUTER JOIN #fresh AS n ON o.symbol = n.symbol AND o.ts = n.ts""",
    string="STRING",
)

#: Ranges to fetch for gaps of over $times bars of $secs seconds: the gap and $buffer seconds on both sides, with the rows expected.
GAP_TASKS = SqlOp(
    """WITH d AS (SELECT symbol, @FLOORSECS(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS start, @FLOORSECS(ts) AS until FROM #bars)
SELECT symbol, start - $buffer AS from_second, until + $buffer AS to_second, CAST(floor((until - start) / CAST($secs AS DOUBLE)) AS BIGINT) - 1 AS expected FROM d WHERE until - start > $times * $secs""",
    secs=3600,
    times="1.5",
    buffer=7200,
)

_GRADE = """WITH d AS (SELECT *, @SECS(lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS step, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret, count(*) OVER (PARTITION BY symbol, ts) AS same FROM #bars),
h AS (SELECT symbol, count(*) AS n, 100 * count(*) / (@SECS(min(ts), max(ts)) / CAST($secs AS DOUBLE) + 1) AS coverage, count(CASE WHEN step > 3 * $secs THEN 1 END) AS gaps, count(CASE WHEN abs(step - $secs) > 0.1 * $secs THEN 1 END) AS odd_steps,
  count(CASE WHEN same > 1 THEN 1 END) AS repeated, count(CASE WHEN close <= 0 OR open <= 0 OR high <= 0 OR low <= 0 THEN 1 END) AS bad_prices, count(CASE WHEN abs(ret) > 0.5 THEN 1 END) AS jumps, count(CASE WHEN volume < 0 THEN 1 END) AS bad_volumes,
  count(*) - count(close) AS nulls FROM d GROUP BY symbol),
s AS (SELECT *, CASE WHEN n >= 100 THEN 100e0 ELSE 70e0 END AS basic, CASE WHEN coverage < 50 THEN 0e0 WHEN gaps > 0 OR odd_steps > 0 THEN greatest(50e0, coverage) ELSE 100e0 END AS continuity,
  greatest(0e0, 100 - 10 * (CASE WHEN bad_prices > 0 THEN 1 ELSE 0 END + CASE WHEN bad_volumes > 0 THEN 1 ELSE 0 END) - 2 * (CASE WHEN jumps > 0 THEN 1 ELSE 0 END + CASE WHEN nulls > 0 THEN 1 ELSE 0 END)) AS quality FROM h)
"""

#: Health of each symbol: scores of basics, continuity and quality (100 less 10 an issue and 2 a warning), their 0.3 / 0.4 / 0.3 mean, its band, and the final check.
HEALTH_SCORE = SqlOp(
    _GRADE
    + """SELECT symbol, n, round(coverage, 4) AS coverage, basic, round(continuity, 4) AS continuity, quality, round(0.3 * basic + 0.4 * continuity + 0.3 * quality, 2) AS health,
  CASE WHEN 0.3 * basic + 0.4 * continuity + 0.3 * quality >= 100 THEN 'excellent' WHEN 0.3 * basic + 0.4 * continuity + 0.3 * quality >= 90 THEN 'good' WHEN 0.3 * basic + 0.4 * continuity + 0.3 * quality >= 80 THEN 'fair'
    WHEN 0.3 * basic + 0.4 * continuity + 0.3 * quality >= 70 THEN 'poor' ELSE 'critical' END AS band,
  repeated = 0 AND gaps = 0 AND coverage >= 95 AND 0.3 * basic + 0.4 * continuity + 0.3 * quality >= 100 AS passed FROM s""",
    secs=3600,
)

#: Last value of each $secs seconds (left-closed), and the bucket before's value where a bucket has none.
RESAMPLE_FFILL = SqlOp(
    """WITH b AS (SELECT symbol, CAST(floor(@FLOORSECS(ts) / CAST($secs AS DOUBLE)) AS BIGINT) AS bucket, @MAXBY(close, ts) AS close FROM #bars GROUP BY symbol, CAST(floor(@FLOORSECS(ts) / CAST($secs AS DOUBLE)) AS BIGINT)),
n AS (SELECT symbol, bucket, close, lead(bucket, 1, bucket + 1) OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS upto FROM b) SELECT symbol, b * $secs AS bucket, round(close, 4) AS close FROM (SELECT symbol, @SEQ(bucket, upto) AS b, close FROM n) AS s""",
    secs=1800,
)

#: Right-closed bars of $times base bars at every offset of a base bar: a window bar that ends with each base bar, as if resampled once an offset and interleaved.
OFFSET_RESAMPLE = SqlOp(
    """WITH k AS (SELECT *, CAST(floor(@FLOORSECS(ts) / CAST($secs AS DOUBLE)) AS BIGINT) AS i FROM #bars), e AS (SELECT symbol, ts, i, open, high, low, close, volume, @EXPLODE($offsets) AS o FROM k),
g AS (SELECT symbol, o, CAST(ceil((i + o) / CAST($times AS DOUBLE)) AS BIGINT) * $times - o AS ends, @MINBY(open, ts) AS open, max(high) AS high, min(low) AS low, @MAXBY(close, ts) AS close, sum(volume) AS volume FROM e GROUP BY symbol, o, CAST(ceil((i + o) / CAST($times AS DOUBLE)) AS BIGINT) * $times - o)
SELECT symbol, ends * $secs AS ends, o AS shift, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM g""",
    secs=3600,
    times=4,
    offsets="0, 1, 2, 3",
)

#: The basic loader's columns: returns, means and ratios to them, volatilities, place in the range, relative volume, momentum.
INDICATORS = SqlOp(
    "WITH r AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS returns FROM #bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, CAST(ts AS $string) AS ts, round(returns, 5) AS returns, "
    "round(CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END, 5) AS log_returns, "
    + ", ".join(f"round(CASE WHEN count(close) OVER w{n} = {n} THEN avg(close) OVER w{n} END, 5) AS ma_{n}, round(CASE WHEN count(close) OVER w{n} = {n} THEN close / nullif(avg(close) OVER w{n}, 0) END, 5) AS ma_ratio_{n}" for n in (5, 10, 20, 50))
    + ", "
    + ", ".join(f"round(CASE WHEN count(returns) OVER w{n} = {n} THEN stddev_samp(returns) OVER w{n} END, 5) AS volatility_{n}" for n in (5, 20))
    + """, round(CASE WHEN count(close) OVER w20 = 20 THEN (close - min(low) OVER w20) / nullif(max(high) OVER w20 - min(low) OVER w20, 0) END, 5) AS position_20,
  round(CASE WHEN count(close) OVER w20 = 20 THEN volume / nullif(avg(volume) OVER w20, 0) END, 5) AS volume_ratio, """
    + ", ".join(f"round(close / nullif(lag(close, {n}) OVER w, 0) - 1, 5) AS momentum_{n}" for n in (5, 10, 20))
    + " FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts), "
    + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10, 20, 50)),
    string="STRING",
)
