"""Turnovers that are equal but for the rounding of their sums."""

from datetime import date, timedelta

from barloom.operators.panel import LIQUIDITY


def bars(spark, series: dict):
    rows = [(s, date(2024, 1, 1) + timedelta(days=i), x, 1.0) for s, values in series.items() for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "symbol bigint, ts date, close double, volume double").coalesce(1)


def test_equal_means_rank_by_symbol(spark):
    # 0.1 + 0.2 + 0.3 is 0.6000000000000001, 0.3 + 0.2 + 0.1 is 0.6
    found = LIQUIDITY({"drop": "0.0"}, bars=bars(spark, {1: [0.3, 0.2, 0.1], 2: [0.1, 0.2, 0.3], 3: [0.1, 0.2, 0.2], 4: [0.3, 0.2, 0.2]})).collect()
    assert [r["symbol"] for r in sorted(found, key=lambda r: r["place"])] == [4, 1, 2, 3]


def test_equal_medians_rank_by_symbol(spark):
    up = [0.1, 0.2, 0.3] * 10
    found = LIQUIDITY({"drop": "0.5"}, bars=bars(spark, {1: [0.3, 0.2, 0.1] * 10, 2: [0.2] * 30, 3: up, 4: up})).collect()
    assert [(r["symbol"], r["place"]) for r in sorted(found, key=lambda r: r["place"])] == [(1, 1), (2, 2)]
