"""Joining, resampling and cleaning of bars(symbol, ts, open, high, low, close, volume)."""

from __future__ import annotations

from .sqlop import SqlOp

#: Each left row takes the latest right row at or before it, nulls of that row included. A union and one window, not a range join.
ASOF = SqlOp(
    """WITH r AS (SELECT symbol, ts, value, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS k FROM #extra),
u AS (SELECT symbol, ts, 0 AS side, ts AS known_at, value, CAST(NULL AS DOUBLE) AS close FROM r WHERE k = 1 UNION ALL SELECT symbol, ts, 1, CAST(NULL AS $ntz), NULL, close FROM #bars),
f AS (SELECT symbol, ts, side, close, max(known_at) OVER (PARTITION BY symbol ORDER BY ts, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS found FROM u)
SELECT f.symbol, CAST(f.ts AS $string) AS ts, round(f.close, 4) AS close, CAST(f.found AS $string) AS extra_ts, round(r.value, 4) AS value
FROM f LEFT JOIN (SELECT * FROM r WHERE k = 1) AS r ON r.symbol = f.symbol AND r.ts = f.found WHERE f.side = 1""",
    string="STRING",
    ntz="TIMESTAMP_NTZ",
)

#: Right-closed, right-labelled bars of $secs seconds; the bar after the last complete one is left out.
RESAMPLE = SqlOp(
    """WITH b AS (SELECT *, CAST(ceil(@FLOORSECS(ts) / CAST($secs AS DOUBLE)) AS BIGINT) * $secs AS bucket, @FLOORSECS(ts) AS secs FROM #bars), e AS (SELECT symbol AS es, floor(max(secs) / CAST($secs AS DOUBLE)) * $secs AS last FROM b GROUP BY symbol)
SELECT symbol, bucket, round(@MINBY(open, ts), 4) AS open, round(max(high), 4) AS high, round(min(low), 4) AS low, round(@MAXBY(close, ts), 4) AS close, sum(volume) AS volume
FROM b JOIN e ON symbol = es WHERE bucket <= last GROUP BY symbol, bucket""",
    secs=14400,
)

#: The bar as it looks at each base bar: running open, high, low and volume within its bucket.
INTRABAR = SqlOp(
    """WITH b AS (SELECT *, CAST(floor(@FLOORSECS(ts) / CAST($secs AS DOUBLE)) AS BIGINT) * $secs AS bucket FROM #bars)
SELECT symbol, CAST(ts AS $string) AS ts, bucket, round(first_value(open) OVER w, 4) AS open, round(max(high) OVER w, 4) AS high, round(min(low) OVER w, 4) AS low, round(close, 4) AS close, sum(volume) OVER w AS volume
FROM b WINDOW w AS (PARTITION BY symbol, bucket ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    secs=14400,
    string="STRING",
)

#: Gaps wider than $times the interval of $secs seconds.
GAPS = SqlOp(
    """WITH d AS (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS start, ts AS until FROM #bars), s AS (SELECT *, @SECS(start, until) AS secs FROM d WHERE start IS NOT NULL)
SELECT symbol, CAST(start AS $string) AS gap_start, CAST(until AS $string) AS gap_end, round(secs / CAST(3600 AS DOUBLE), 4) AS hours, CAST(floor(secs / CAST($secs AS DOUBLE)) AS BIGINT) - 1 AS missing FROM s WHERE secs > $times * $secs""",
    secs=3600,
    times="1.5",
    string="STRING",
)

#: Coverage, anomalies and scores of each symbol's bars.
HEALTH = SqlOp(
    """WITH d AS (SELECT *, @SECS(lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS step, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM #bars)
SELECT symbol, count(*) AS n, round(100 * count(*) / (@SECS(min(ts), max(ts)) / CAST($secs AS DOUBLE) + 1), 4) AS coverage, count(CASE WHEN abs(step - $secs) > 0.1 * $secs THEN 1 END) AS odd_steps, count(CASE WHEN step > 3 * $secs THEN 1 END) AS gaps,
  count(CASE WHEN close <= 0 OR open <= 0 OR high <= 0 OR low <= 0 THEN 1 END) AS bad_prices, count(CASE WHEN abs(ret) > 0.5 THEN 1 END) AS jumps, count(CASE WHEN volume < 0 THEN 1 END) AS bad_volumes,
  count(CASE WHEN high < low OR high < greatest(open, close) OR low > least(open, close) THEN 1 END) AS bad_shapes FROM d GROUP BY symbol""",
    secs=3600,
)

#: Last row of each (symbol, ts) by seq.
KEEP_LAST = SqlOp("SELECT symbol, CAST(ts AS $string) AS ts, round(value, 4) AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS k FROM #extra) AS x WHERE k = 1", string="STRING")

#: Prices of zero become the last good one; high and low are put around open and close; volume is at least zero.
REPAIR = SqlOp(
    """WITH p AS (SELECT symbol, ts, @IGN(nullif(open, 0)) OVER w AS o, @IGN(nullif(high, 0)) OVER w AS h, @IGN(nullif(low, 0)) OVER w AS l, @IGN(nullif(close, 0)) OVER w AS c, greatest(volume, 0) AS v
  FROM #bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), q AS (SELECT symbol, ts, o, greatest(h, l) AS h, least(l, greatest(h, l)) AS l, c, v FROM p)
SELECT symbol, CAST(ts AS $string) AS ts, round(greatest(least(o, h), l), 4) AS open, round(h, 4) AS high, round(l, 4) AS low, round(greatest(least(c, h), l), 4) AS close, v AS volume FROM q""",
    string="STRING",
)

#: Signed pressure: |return| * volume, split by sign, summed over $secs seconds.
PRESSURE = SqlOp(
    """WITH r AS (SELECT symbol, CAST(floor(@FLOORSECS(ts) / CAST($secs AS DOUBLE)) AS BIGINT) * $secs AS bucket, volume, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM #bars)
SELECT symbol, bucket, round(sum(CASE WHEN ret < 0 THEN abs(ret) * volume ELSE 0 END), 4) AS long_value, round(sum(CASE WHEN ret > 0 THEN ret * volume ELSE 0 END), 4) AS short_value, count(ret) AS n FROM r GROUP BY symbol, bucket""",
    secs=14400,
)

#: Clip each symbol's close to the quartiles widened by 1.5 times their distance, then standardise it.
CLIP_AND_SCALE = SqlOp(
    """WITH q AS (SELECT symbol AS qs, @PCT(close, 0.25) AS q1, @PCT(close, 0.75) AS q3 FROM #bars GROUP BY symbol), c AS (SELECT b.symbol, b.ts, least(greatest(b.close, q.q1 - 1.5 * (q.q3 - q.q1)), q.q3 + 1.5 * (q.q3 - q.q1)) AS x FROM #bars AS b JOIN q ON b.symbol = q.qs)
SELECT symbol, CAST(ts AS $string) AS ts, round(x, 4) AS clipped, round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 5) AS z FROM c WINDOW w AS (PARTITION BY symbol)""",
    string="STRING",
)

#: Rows, span and ranges of each symbol.
INVENTORY = SqlOp("SELECT symbol, count(*) AS n, CAST(min(ts) AS $string) AS first_ts, CAST(max(ts) AS $string) AS last_ts, round(min(low), 4) AS low, round(max(high), 4) AS high, count(CASE WHEN close IS NULL THEN 1 END) AS nulls FROM #bars GROUP BY symbol", string="STRING")
