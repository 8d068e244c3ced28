"""Small helpers of the factor library."""

import pytest

from barloom.operators import library as L


def test_timeframes_lags_splits_and_leaking_names():
    assert [L.seconds_of(t) for t in ("15m", "4h", "1d", "2w")] == [900, 14400, 86400, 1209600]
    with pytest.raises(ValueError):
        L.seconds_of("soon")
    assert (L.signal_lag(), L.signal_lag({"trade_lag": 2, "lookahead": 3}), L.signal_lag({}, {"shift": 0})) == (1, 5, 0)
    assert L.split_ratios(3, 1) == (0.75, 0.25, 0.0) and L.split_ratios(0, 0) == (0.8, 0.2, 0.0)
    leaks = "fwd_ret next_close PnL_1 profit sharpe_20 signal_x predicted pred_1 forecast return_t+1 y_hat label".split()
    assert L.features_only(["close", "future_return_5", "Target", "y", "rsi_14", "yield_10", *leaks]) == ["close", "rsi_14", "yield_10"]
    assert L.signal_lag({"lookahead": 2}, {"lag": 3}, computation={"future_bars": 9}) == 5 and L.signal_lag({"lag": "soon"}) == 1 and L.signal_lag({"shift": -4}) == 0


def test_health_names_what_is_missing_and_what_is_left_over(spark):
    library = L.definitions(spark, [("a", "x", False, "close"), ("b", "x", True, "open")])
    found = L.health(library, spark.createDataFrame([("b",), ("c",), ("c",)], "name string"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", "missing"), ("c", "orphan")]
    assert [r["name"] for r in L.search(library, lookahead=True).collect()] == ["b"]


def test_stats_and_differences_of_two_libraries(spark):
    mine = L.definitions(spark, [("a", "x", False, "close"), ("b", "x", True, "open"), ("c", "y", False, "volume")])
    theirs = L.definitions(spark, [("a", "x", False, "close"), ("b", "x", True, "high"), ("d", "y", False, "low")])
    assert sorted(tuple(r) for r in L.diff(mine, theirs).collect()) == [("a", "identical"), ("b", "different"), ("c", "missing"), ("d", "new")]
    assert sorted((r["family"], r["n"], r["lookahead"]) for r in L.stats(mine).collect()) == [("x", 2, 1), ("y", 1, 0)]
