"""Queries for dated universes and strict intrabar replay, with SQL written from the definitions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barloom.operators import replay as R
from barloom.operators.joins import join_extras
from barloom.operators.universe import Rules, counts, members_only, universe
from barloom.sources.bars import DUCK_BARS, event_bars, table_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

# ---- universe ----------------------------------------------------------------------------------
# Customers stand for coins: one in seven trades behind a prefix, under an alias, under a longer name, under its coin_id, or not at all.
_MARKET = """CASE c % 7 WHEN 1 THEN '1000C' || lpad(CAST(c AS {s}), 6, '0') WHEN 2 THEN 'Z' || lpad(CAST(c AS {s}), 6, '0') WHEN 3 THEN 'C' || lpad(CAST(c AS {s}), 6, '0') || 'X'
WHEN 4 THEN 'CUSTOMER#' || lpad(CAST(c AS {s}), 9, '0') WHEN 5 THEN 'QQ' || CAST(c AS {s}) ELSE 'C' || lpad(CAST(c AS {s}), 6, '0') END"""
_TRADES = "SELECT {market} AS symbol, ts, close, volume FROM (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS ts, o_totalprice / 1000 AS close, CAST(1 + o_orderkey % 5 AS DOUBLE) AS volume FROM orders) AS o"
_RANKS = """SELECT 'c' || lpad(CAST(c AS {s}), 6, '0') AS base, 'customer#' || lpad(CAST(c AS {s}), 9, '0') AS coin_id, row_number() OVER (PARTITION BY m ORDER BY paid DESC, c) AS rank,
CAST(m + INTERVAL 1 MONTH AS DATE) AS valid_from, CAST(m + INTERVAL 4 MONTH AS DATE) AS valid_to
FROM (SELECT o_custkey AS c, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(sum(CAST(round(o_totalprice * 100, 0) AS BIGINT)) AS BIGINT) AS paid FROM orders GROUP BY 1, 2) AS p"""
_EXCLUDED = """SELECT 'C' || lpad(CAST(c_custkey AS {s}), 6, '0') AS base, 'stable' AS kind, CAST(NULL AS DATE) AS valid_from, CAST(NULL AS DATE) AS valid_to FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'C' || lpad(CAST(c_custkey AS {s}), 6, '0'), 'blacklist', DATE '1998-01-01', DATE '2000-01-01' FROM customer WHERE c_acctbal < 1000"""
_ALIASES = "SELECT 'C' || lpad(CAST(c_custkey AS {s}), 6, '0') AS name, 'z' || lpad(CAST(c_custkey AS {s}), 6, '0') AS alias FROM customer"
_DATES = [date(y, m, 1) for y in range(1996, 2002) for m in (1, 4, 7, 10)]
_RULES = Rules(max_rank=150, min_volume=800, min_age_days=700)


def _found(spark, sf_dir):
    read = lambda text, *tables: table_sql(spark, sf_dir, text.format(s="STRING", market=_MARKET.format(s="STRING")), *tables)
    trades = read(_TRADES, "orders")
    return trades, universe(trades, read(_RANKS, "orders"), _DATES, _RULES, read(_EXCLUDED, "customer"), read(_ALIASES, "customer"))


def _universe(spark, sf_dir):
    found = _found(spark, sf_dir)[1]
    return found.select(F.col("as_of").cast("string").alias("as_of"), "base", "rank", "symbol", F.round("avg_volume", 9).alias("avg_volume"), "age_days", F.coalesce("reason", F.lit("passed")).alias("reason"))


def _members(spark, sf_dir):
    trades, found = _found(spark, sf_dir)
    kept = members_only(trades, found, _DATES)
    return kept.groupBy("as_of", "symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 6).alias("closes")).select(F.col("as_of").cast("string").alias("as_of"), "symbol", "n", "closes")


def _counts(spark, sf_dir):
    return counts(_found(spark, sf_dir)[1]).select(F.col("as_of").cast("string").alias("as_of"), "reason", "n")


QUERIES |= {"universe_filter": _universe, "universe_counts": _counts, "universe_members": _members}
_DUCK = {"s": "VARCHAR", "market": _MARKET.format(s="VARCHAR")}
_STEPS = f"""WITH trades AS ({_TRADES.format(**_DUCK)}), ranks AS ({_RANKS.format(**_DUCK)}), excluded AS ({_EXCLUDED.format(**_DUCK)}), dates AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in _DATES)}]) AS as_of),
scanned AS (SELECT as_of, base, coin_id, rank FROM dates JOIN ranks ON as_of >= valid_from AND as_of < valid_to WHERE rank <= 150),
listed AS (SELECT DISTINCT symbol FROM trades), bases AS (SELECT DISTINCT base, coin_id FROM scanned),
sure AS (SELECT base, coin_id, coalesce(a.symbol, p.symbol, z.symbol, i.symbol, x.symbol) AS symbol FROM bases LEFT JOIN listed AS a ON a.symbol = upper(base) LEFT JOIN listed AS p ON p.symbol = '1000' || upper(base)
  LEFT JOIN listed AS z ON z.symbol = 'Z' || substr(base, 2) LEFT JOIN listed AS i ON i.symbol = upper(coin_id) LEFT JOIN listed AS x ON x.symbol = upper(base) || 'X'),
days AS (SELECT symbol, ts, arg_max(close, (ts, close)) * sum(volume) AS traded FROM (SELECT symbol, ts, max(close) AS close, sum(volume) AS volume FROM trades GROUP BY symbol, ts) AS q GROUP BY symbol, ts),
stats AS (SELECT symbol, ts, avg(traded) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) AS avg_volume, min(ts) OVER (PARTITION BY symbol) AS first_day FROM days),
rows_ AS (SELECT s.as_of, s.base, s.coin_id, s.rank, u.symbol, (SELECT count(*) FROM excluded AS e WHERE e.base = upper(s.base) AND e.kind = 'stable') AS stable,
  (SELECT count(*) FROM excluded AS e WHERE e.base = upper(s.base) AND e.kind = 'blacklist' AND s.as_of >= e.valid_from AND s.as_of < e.valid_to) AS black FROM scanned AS s JOIN sure AS u ON u.base = s.base),
met AS (SELECT r.*, t.avg_volume, date_diff('day', t.first_day, r.as_of) AS age_days FROM rows_ AS r ASOF LEFT JOIN stats AS t ON r.symbol = t.symbol AND r.as_of >= t.ts),
found AS (SELECT *, CASE WHEN stable > 0 THEN 'stable' WHEN black > 0 THEN 'blacklist' WHEN symbol IS NULL THEN 'market' WHEN coalesce(avg_volume, 0) < 800 THEN 'volume' WHEN coalesce(age_days, 0) < 700 THEN 'age' ELSE 'passed' END AS reason FROM met)"""
SQL["universe_filter"] = f"{_STEPS} SELECT CAST(as_of AS VARCHAR) AS as_of, base, rank, symbol, round(avg_volume, 9) AS avg_volume, age_days, reason FROM found"
SQL["universe_counts"] = f"{_STEPS} SELECT CAST(as_of AS VARCHAR) AS as_of, reason, count(*) AS n FROM found GROUP BY ALL"
SQL["universe_members"] = f"""{_STEPS} SELECT CAST(f.as_of AS VARCHAR) AS as_of, t.symbol, count(*) AS n, round(sum(t.close), 6) AS closes FROM (SELECT * FROM trades ASOF JOIN dates ON trades.ts >= dates.as_of) AS t
JOIN (SELECT DISTINCT as_of, symbol FROM found WHERE reason = 'passed') AS f ON f.as_of = t.as_of AND f.symbol = t.symbol GROUP BY ALL"""


# ---- strict replay -------------------------------------------------------------------------------
_LOOK = 48


def _replay(spark, sf_dir):
    seen = R.replay(event_bars(spark, sf_dir), {"momentum": R.momentum(6), "zscore": R.zscore(12), "place": R.range_place()}, 14400, lookback=_LOOK)
    return seen.select("symbol", F.col("ts").cast("string").alias("ts"), F.round("momentum", 6).alias("momentum"), F.round("zscore", 5).alias("zscore"), F.round("place", 6).alias("place"))


QUERIES["intrabar_replay"] = _replay
SQL["intrabar_replay"] = f"""WITH b AS ({DUCK_BARS}), k AS (SELECT *, CAST(floor(epoch(ts) / 14400) AS BIGINT) * 14400 AS starts, CAST(ceil(epoch(ts) / 14400) AS BIGINT) * 14400 AS ends FROM b),
h AS (SELECT symbol, ends, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM k GROUP BY symbol, ends),
s AS (SELECT symbol, ends, lag(close, 5) OVER w AS back, sum(close) OVER (w ROWS 10 PRECEDING) AS s1, sum(close * close) OVER (w ROWS 10 PRECEDING) AS s2, count(*) OVER (w ROWS 10 PRECEDING) AS n,
  max(high) OVER (w ROWS {_LOOK - 1} PRECEDING) AS hi, min(low) OVER (w ROWS {_LOOK - 1} PRECEDING) AS lo FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ends)),
p AS (SELECT symbol, ts, starts, close AS c, max(high) OVER v AS high, min(low) OVER v AS low FROM k WINDOW v AS (PARTITION BY symbol, starts ORDER BY ts ROWS UNBOUNDED PRECEDING)),
j AS (SELECT p.*, s.back, s.s1 + c AS t1, s.s2 + c * c AS t2, s.n, greatest(p.high, s.hi) AS top, least(p.low, s.lo) AS bottom FROM p ASOF LEFT JOIN s ON p.symbol = s.symbol AND p.starts >= s.ends)
SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(c / back - 1, 6) AS momentum, CASE WHEN n = 11 AND t2 - t1 * t1 / 12 > 1e-9 THEN round((c - t1 / 12) / sqrt((t2 - t1 * t1 / 12) / 11), 5) END AS zscore,
  CASE WHEN top > bottom THEN round((c - bottom) / (top - bottom), 6) END AS place FROM j"""

# ---- series of the whole market -------------------------------------------------------------------
_FEAR = "SELECT CAST(ts AS TIMESTAMP) AS ts, value AS fear, CAST(CASE WHEN value > 20 THEN user_id END AS DOUBLE) AS volume FROM events WHERE event_type = 'error'"
_CALM = "SELECT CAST(date_trunc('day', ts) + INTERVAL 30 HOUR AS TIMESTAMP) AS ts, CAST(count(*) AS DOUBLE) AS calm FROM events WHERE value < 3 GROUP BY 1"


def _market(spark, sf_dir):
    bars = event_bars(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close", "volume")
    out = join_extras(bars, {"fear": table_sql(spark, sf_dir, _FEAR, "events"), "calm": table_sql(spark, sf_dir, _CALM, "events")})
    return out.select("symbol", F.col("ts").cast("string").alias("ts"), F.round("close", 4).alias("close"), "volume", F.round("fear", 4).alias("fear"), "fear_volume", "calm")


QUERIES["join_market_extras"] = _market
SQL["join_market_extras"] = f"""WITH b AS ({DUCK_BARS}), f AS (SELECT ts, max((fear, volume)) AS r FROM ({_FEAR}) AS q GROUP BY ts), c AS ({_CALM})
SELECT b.symbol, CAST(b.ts AS VARCHAR) AS ts, round(b.close, 4) AS close, b.volume, round(r[1], 4) AS fear, r[2] AS fear_volume, c.calm FROM b ASOF LEFT JOIN f ON b.ts >= f.ts ASOF LEFT JOIN c ON b.ts >= c.ts"""
