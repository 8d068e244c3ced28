"""Readers, archive parsers, upserts and evaluations on small files."""

import zipfile

import pytest

from barloom.sources import files as S


def test_times_of_every_kind(spark):
    rows = spark.createDataFrame([("1704067200",), ("1704067200000",), ("1704067200000000",), ("2024-01-01 00:00:00",), ("nonsense",), (None,)], "t string")
    found = [r[0] and r[0].strftime("%Y-%m-%d %H:%M") for r in rows.select(S.as_time(rows.t, "string")).collect()]
    assert len(set(found[:4])) == 1 and found[0] is not None and found[4:] == [None, None]


def test_scan_normalises_filters_and_refuses(spark, tmp_path):
    path = tmp_path / "futures"
    path.mkdir()
    (path / "BTC_USDT-1h-futures.csv").write_text("Time,Open_price,HIGH,Low,close,Volume,extra\n" + "".join(f"{1704067200 + 3600 * i},{i},{i + 1},{i},{i},5,x\n" for i in range(6)))
    (path / "ETH_USDT-1h-futures.csv").write_text("time,open\n1,2\n")
    bars = S.scan_bars(spark, str(tmp_path), "BTC", "1h", start="2024-01-01 01:00:00", end="2024-01-01 04:00:00")
    assert [r["open"] for r in bars.orderBy("ts").collect()] == [1.0, 2.0, 3.0, 4.0] and bars.columns == ["ts", *S.PRICES, "extra", "symbol"]
    assert [r["open"] for r in S.page(bars, 2, 1).collect()] == [3.0, 4.0]
    with pytest.raises(ValueError):
        S.scan_bars(spark, str(tmp_path), "ETH", "1h")
    with pytest.raises(FileNotFoundError):
        S.scan_bars(spark, str(tmp_path), "SOL", "1h")
    assert S.scan_many(spark, str(tmp_path), ["BTC", "ETH", "SOL"], "1h").count() == 6
    listed = S.inventory(spark, str(path / "BTC*"), "csv").collect()
    assert [(r["symbol"], r["timeframe"], r["rows"]) for r in listed] == [("BTC_USDT", "1h", 6)]
    with pytest.raises(ValueError):
        S.read_any(spark, "x.pickle")


def test_feather_files_are_bars_too(spark, tmp_path):
    import pandas as pd

    path = tmp_path / "futures"
    path.mkdir()
    for base, n in (("BTC", 5), ("ETH", 3)):
        table = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=n, freq="h", tz="UTC"), **{c: [float(i) for i in range(n)] for c in S.PRICES}, "trades": range(n)})
        table.to_feather(path / f"{base}_USDT-1h-futures.feather")
    bars = S.scan_bars(spark, str(tmp_path), "BTC", "1h").orderBy("ts").collect()
    assert [r["open"] for r in bars] == [0.0, 1.0, 2.0, 3.0, 4.0] and [r["trades"] for r in bars] == [0, 1, 2, 3, 4]
    assert (bars[1]["ts"] - bars[0]["ts"]).total_seconds() == 3600
    assert S.read_any(spark, str(path / "*.feather")).count() == 8 and S.scan_many(spark, str(tmp_path), ["BTC", "ETH"], "1h").count() == 8
    with pytest.raises(ValueError):
        S.write_any(spark.range(1), str(tmp_path / "x.feather"))


def test_metrics_and_funding_fall_back(spark):
    rows = spark.createDataFrame([("1704067200000", "5", "x")], "timestamp string, sum_open_interest string, other string")
    assert [(r["open_interest"], r["lsr_top_account"]) for r in S.metrics(rows).collect()] == [(5.0, None)]
    with pytest.raises(ValueError):
        S.funding(rows)


def test_archives_with_and_without_header(spark, tmp_path):
    for name, text in (("a", "1704067200000,1,2,0.5,1.5,10,0,0,0,4,5,0\n"), ("b", "open_time,open,high,low,close,volume\n1704070800000,2,3,1,2,x\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("rows.csv", text)
    (tmp_path / "c.zip").write_bytes(b"no archive")
    bars = S.klines(S.zip_csv(spark, str(tmp_path / "*.zip"), S.KLINE)).orderBy("ts").collect()
    assert [(r["open"], r["volume"], r["taker_buy_base"]) for r in bars] == [(1.0, 10.0, 4.0), (2.0, None, None)]
    marks = S.price_series(S.zip_csv(spark, str(tmp_path / "a.zip"), S.KLINE), "mark").head()
    assert marks["mark_high"] == 2.0
    rates = spark.createDataFrame([("1704067200000", "0.0001"), (None, "1"), ("1704067200000", "bad")], "calc_time string, last_funding_rate string")
    assert [r["funding_rate"] for r in S.funding(rates).collect()] == [0.0001]


def test_upsert_takes_new_rows_and_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "table")
    assert S.current(spark, path) is None
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert S.upsert(spark, one, path, ["k"]) == {"new": 2, "stored": 0, "result": 2}
    two = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert S.upsert(spark, two, path, ["k"]) == {"new": 3, "stored": 2, "result": 3}
    assert sorted(tuple(r) for r in S.current(spark, path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_evaluations_are_appended_and_rolled_up(spark, tmp_path):
    path = str(tmp_path / "evaluations")
    for ic in (0.1, 0.3):
        S.save_evaluation(spark.createDataFrame([("f", ic), ("g", -ic)], "factor string, ic double"), path)
    assert S.evaluations(spark, path, "f").count() == 2
    assert {r["factor"]: (round(r["ic"], 6), r["evaluations"]) for r in S.roll_up(S.evaluations(spark, path), ["ic"]).collect()} == {"f": (0.2, 2), "g": (-0.2, 2)}


def test_market_series_fill_forward(spark):
    quotes = spark.createDataFrame([("2024-01-01 00:10:00", "X", 4.0), ("2024-01-01 00:20:00", "X", 5.0), ("2024-01-01 03:00:00", "Y", 2.0)], "ts string, ticker string, close double")
    quotes = quotes.withColumn("ts", quotes.ts.cast("timestamp"))
    found = S.macro(quotes, {"spx": "X", "us10y_yield": "Y"}, 3600).orderBy("ts").collect()
    assert [(r["spx"], r["us10y_yield"]) for r in found] == [(5.0, None), (5.0, None), (5.0, None), (5.0, 0.02)]
    vix = quotes.filter("ticker = 'X'").selectExpr("ts", "close AS vix")
    caps = quotes.filter("ticker = 'Y'").selectExpr("ts", "close AS stable", "4.0D AS coin")
    assert [(r["vix"], r["stablecoin_supply_ratio"]) for r in S.sentiment(vix, caps, 3600).orderBy("ts").collect()][-1] == (5.0, 0.5)


def test_upsert_of_repeated_keys_keeps_the_latest(spark, tmp_path):
    rows = [(1, 5, "late"), (1, 2, "early"), (1, None, "never"), (2, None, "only"), (3, 1, "a"), (3, 1, "b")]
    kept = []
    for turn, order in enumerate((rows, rows[::-1])):
        path = str(tmp_path / f"table{turn}")
        assert S.upsert(spark, spark.createDataFrame(order, "k int, seq int, v string").repartition(3), path, ["k"], ("seq",)) == {"new": 6, "stored": 0, "result": 3}
        kept.append({r["k"]: r["v"] for r in S.current(spark, path).collect()})
    assert kept[0] == kept[1] and kept[0][1] == "late" and kept[0][2] == "only"
