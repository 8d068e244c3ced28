"""Bars from event tables: one long frame of (symbol, ts, open, high, low, close, volume, extras)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Hourly bars of each event type. The extras stand for the auxiliary series of the factors that need them.
EVENT_BARS = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, {min_by}(value, ts) AS open, max(value) AS high, min(value) AS low, {max_by}(value, ts) AS close,
       CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS taker_buy_base,
       CAST(count(DISTINCT user_id) AS DOUBLE) AS open_interest, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS lsr_global_account,
       CAST(sum(CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS lsr_top_account, CAST(max(user_id) AS DOUBLE) AS lsr_top_position,
       {max_by}(value, ts) / nullif(min(value), 0) - 1 AS basis, CAST(max(event_id) % 7 - 3 AS DOUBLE) / 100 AS funding_rate, CAST(1000 AS DOUBLE) AS circulating_supply
FROM events GROUP BY event_type, date_trunc('hour', ts)
"""
SPARK_BARS = EVENT_BARS.format(min_by="min_by", max_by="max_by")
DUCK_BARS = EVENT_BARS.format(min_by="arg_min", max_by="arg_max")

#: Daily bars of each user: the panel for cross-sections.
USER_BARS = """
SELECT user_id AS symbol, date_trunc('day', ts) AS ts, {min_by}(value, ts) AS open, max(value) AS high, min(value) AS low, {max_by}(value, ts) AS close,
       CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY user_id, date_trunc('day', ts)
"""
SPARK_PANEL = USER_BARS.format(min_by="min_by", max_by="max_by")
DUCK_PANEL = USER_BARS.format(min_by="arg_min", max_by="arg_max")


def table_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run ``sql`` with the named tables of a folder bound by parameter, without registering views."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}")
    return spark.sql(sql, **frames)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_sql(spark, sf_dir, SPARK_BARS, "events")


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_sql(spark, sf_dir, SPARK_PANEL, "events")
