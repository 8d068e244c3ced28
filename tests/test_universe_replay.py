"""Dated universes and strict replay against plain loops."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from barloom.operators import replay as R
from barloom.operators.joins import asof_market
from barloom.operators.universe import Rules, members_only, resolve, universe, valid_at

_RANGES = "base string, coin_id string, rank int, valid_from date, valid_to date"


def test_validity_is_open_at_the_end_and_null_is_without_bound(spark):
    a, b, c = date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)
    rows = spark.createDataFrame([("x", "", 1, a, c), ("y", "", 1, None, None), ("z", "", 1, c, None), ("w", "", 1, b, b)], _RANGES)
    found = sorted((r["base"], r["as_of"]) for r in valid_at(rows, [c, a, b, b]).collect())
    assert found == [("x", a), ("x", b), ("y", a), ("y", b), ("y", c), ("z", c)]
    assert valid_at(rows, []).count() == 0


def test_names_find_their_market_in_order(spark):
    markets = ["BTC", "1000PEPE", "10000SATS", "POL", "1000LUNC", "DOGECOIN", "WIFHAT", "LUNA2", "LUNA3", "A", "", None, "BTC"]
    names = [("btc", "bitcoin"), ("Pepe", "pepe"), ("sats", "sats-ordi"), ("matic", "polygon"), ("xxx", "lunac"), ("xdg", "dogecoin"), ("wif", "dogwifhat"), ("luna", "terra"), ("qz", "qz"), ("", None), (None, "nothing"), ("btc", "bitcoin")]
    aliases = [("MATIC", "pol"), ("LUNAC", "lunc")]
    found = resolve(spark.createDataFrame(names, "base string, coin_id string"), spark.createDataFrame([(m,) for m in markets], "symbol string"), spark.createDataFrame(aliases, "name string, alias string")).collect()
    got = {(r["base"], r["coin_id"]): r["symbol"] for r in found}
    assert len(found) == len(got)
    # "terra" and "luna" lie in two markets and hold a third ("A"); "dogwifhat" holds "WIFHAT" and "A"
    want = {("btc", "bitcoin"): "BTC", ("Pepe", "pepe"): "1000PEPE", ("sats", "sats-ordi"): "10000SATS", ("matic", "polygon"): "POL", ("xxx", "lunac"): "1000LUNC", ("xdg", "dogecoin"): "DOGECOIN", ("wif", "dogwifhat"): None, ("luna", "terra"): None, ("qz", "qz"): None}
    assert {k: got.get(k) for k in want} == want
    alone = resolve(spark.createDataFrame([("wif", "hat")], "base string, coin_id string"), spark.createDataFrame([("WIFHAT",), ("ZZ",)], "symbol string"))
    assert alone.collect()[0]["symbol"] == "WIFHAT"


def test_universe_reasons_and_members(spark):
    days = [date(2024, 1, 1) + timedelta(d) for d in range(120)]
    bars = [(s, datetime.combine(d, datetime.min.time()) + timedelta(hours=h), 10.0 if h else 99.0, v / 2) for s, v, since in (("AA", 50.0, 0), ("BB", 50.0, 90), ("CC", 1.0, 0), ("DD", 50.0, 0)) for d in days[since:] for h in (0, 12)]
    table = spark.createDataFrame([*bars, (None, datetime(2024, 1, 1), 1.0, 1.0), ("AA", None, 1.0, 1.0), ("AA", datetime(2024, 1, 5, 13), None, 0.0)], "symbol string, ts timestamp, close double, volume double").selectExpr("*", "1 as rank", "'x' as reason")
    ranks = spark.createDataFrame([("aa", "a-", 1, None, None), ("bb", "b-", 2, None, None), ("cc", "c-", 3, None, None), ("dd", "d-", 4, None, None), ("ee", "e-", 5, None, None), ("ff", "f-", 99, None, None), (None, "n", 1, None, None), ("dd", "d-", None, None, None)], _RANGES)
    barred = spark.createDataFrame([("dd", "blacklist", date(2024, 4, 1), None), ("DD", "stable", None, date(2024, 2, 1)), ("aa", "other", None, None)], "base string, kind string, valid_from date, valid_to date")
    dates = [days[20], days[60], days[119]]
    found = universe(table, ranks, dates, Rules(max_rank=10, min_volume=400, min_age_days=30, volume_days=30), barred)
    got = {(r["base"], r["as_of"]): r for r in found.collect()}
    assert len(got) == 15 == found.count()
    reasons = {b: [got[(b, d)]["reason"] for d in dates] for b in ("aa", "bb", "cc", "dd", "ee")}
    assert reasons == {"aa": ["age", None, None], "bb": ["volume", "volume", "age"], "cc": ["volume"] * 3, "dd": ["stable", None, "blacklist"], "ee": ["market"] * 3}
    assert got[("aa", dates[1])]["avg_volume"] == pytest.approx(500.0) and got[("bb", dates[2])]["age_days"] == 29
    kept = members_only(table, found, dates)
    assert sorted({(r["symbol"], r["as_of"]) for r in kept.collect()}) == [("AA", dates[1]), ("AA", dates[2]), ("DD", dates[1])]
    assert min(r["ts"] for r in kept.collect()) == datetime.combine(dates[1], datetime.min.time())
    assert universe(table.limit(0), ranks, dates, Rules(), barred).filter("reason is null").count() == 0
    assert universe(table, ranks.limit(0), dates).count() == 0


def plain_replay(frame: pd.DataFrame, factors: dict, secs: int, lookback: int) -> pd.DataFrame:
    at = frame["ts"].astype("datetime64[s]").astype("int64").to_numpy()
    out = []
    for i in range(len(frame)):
        start = at[i] // secs * secs
        ends = -(-at // secs) * secs
        done = frame[ends <= start].assign(e=ends[ends <= start]).groupby("e").agg(open=("open", "first"), high=("high", "max"), low=("low", "min"), close=("close", "last"), volume=("volume", "sum")).tail(lookback)
        part = frame[(at >= start) & (np.arange(len(frame)) <= i)]
        now = {"open": part["open"].dropna().iloc[0] if part["open"].notna().any() else np.nan, "high": part["high"].max(), "low": part["low"].min(), "close": frame["close"].iloc[i], "volume": part["volume"].sum()}
        seen = {c: np.append(done[c].to_numpy(float), now[c])[None, :] for c in now}
        out.append({"ts": frame["ts"].iloc[i], **{n: f(seen)[0] for n, f in factors.items()}})
    return pd.DataFrame(out)


_FACTORS = {"momentum": R.momentum(3), "zscore": R.zscore(5), "place": R.range_place(), "bars": lambda seen: np.full(len(seen["close"]), seen["close"].shape[1], float), "opened": lambda seen: seen["open"][:, -1], "summed": lambda seen: seen["volume"].sum(axis=1)}


@pytest.mark.parametrize("lookback,block", [(7, 3), (4, 1000), (1, 1), (200, 16)])
def test_replay_equals_a_plain_replay(spark, lookback, block):
    rng = np.random.default_rng(4)
    frames = []
    for symbol, n in (("hot", 160), ("b", 40), ("one", 1)):
        minutes = np.sort(rng.choice(np.arange(0, 60 * n, 20), n, replace=False))  # holes, and bars right on the edges
        close = 100 + rng.normal(0, 1, n).cumsum()
        frames.append(pd.DataFrame({"symbol": symbol, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, "m"), "open": close + 0.1, "high": close + 1, "low": close - 1, "close": close, "volume": rng.integers(1, 9, n).astype(float)}))
    table = pd.concat(frames, ignore_index=True)
    table.loc[[5, 6, 30], "open"] = np.nan
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in table.itertuples(index=False, name=None)]
    rows += [(None, datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0), ("b", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double").selectExpr("*", "1 as block", "2 as seen")
    got = R.replay(bars, _FACTORS, 4 * 3600, lookback, block).toPandas()
    assert len(got) == len(table)
    for symbol, frame in table.groupby("symbol"):
        want = plain_replay(frame.reset_index(drop=True), _FACTORS, 4 * 3600, lookback)
        mine = got[got["symbol"] == symbol].sort_values("ts").reset_index(drop=True)
        for name in _FACTORS:
            np.testing.assert_allclose(mine[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-9)


def test_replay_of_nothing_and_of_repeated_times(spark):
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    assert R.replay(spark.createDataFrame([], schema), _FACTORS, 3600).count() == 0
    at = datetime(2024, 1, 1, 0, 30)
    twice = R.replay(spark.createDataFrame([("a", at, 1.0, 1.0, 1.0, 1.0, 2.0), ("a", at, 2.0, 2.0, 2.0, 2.0, 3.0), ("a", at, 2.0, 2.0, 2.0, None, 3.0)], schema), _FACTORS, 3600).collect()
    assert sorted(r["summed"] for r in twice) == [2.0, 5.0, 8.0] and {r["bars"] for r in twice} == {1.0} and {r["opened"] for r in twice} == {1.0}
    with pytest.raises(ValueError):
        R.replay(spark.createDataFrame([], schema), _FACTORS, 3600, lookback=0)


def test_market_series_reach_over_days_and_carry_their_nulls(spark):
    day = datetime(2024, 1, 1)
    hours = lambda *hs: [day + timedelta(hours=h) for h in hs]
    asked = hours(0, 1, 5, 30, 30, 100, 101)
    main = spark.createDataFrame([(f"s{i % 2}", t, 1.0 * i) for i, t in enumerate(asked)] + [("s0", None, 9.0)], "symbol string, ts timestamp, value double")
    extra = spark.createDataFrame([(t, v, w) for t, v, w in zip(hours(1, 1, 4, 50, 101), (1.0, 2.0, None, 5.0, 6.0), "abcde")] + [(None, 7.0, "z")], "ts timestamp, value double, tag string")
    got = {(r["ts"], r["value"]): (r["x_value"], r["tag"]) for r in asof_market(main, extra, prefix="x").collect()}
    assert got == dict(zip([*zip(asked, map(float, range(7))), (None, 9.0)], [(None, None), (2.0, "b"), (None, "c"), (None, "c"), (None, "c"), (5.0, "d"), (6.0, "e"), (None, None)]))
    assert [r["x_value"] for r in asof_market(main, extra.limit(0), prefix="x").collect()] == [None] * 8
    assert asof_market(main.limit(0), extra, prefix="x").count() == 0
