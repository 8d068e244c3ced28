"""Recursive indicators against hand-made values and plain loops; weights against numpy."""

import numpy as np
import pandas as pd
import pytest

from barloom.functions.recursive import kama, market_structure, parabolic_sar, supertrend
from barloom.operators.selection import duplicate_groups, greedy, shrink, unit_l1, weights


def test_recursive_indicators_restart_with_each_symbol(spark, sf_dir):
    from barloom.catalog import QUERIES

    out = QUERIES["factors_recursive"](spark, sf_dir).toPandas()
    assert len(out) and out["symbol"].nunique() > 1
    numbers = out.select_dtypes("number")
    assert np.isfinite(numbers.to_numpy(dtype=float)[~pd.isna(numbers.to_numpy(dtype=float))]).all()


def test_weights_have_unit_size(spark, sf_dir):
    from barloom.catalog import QUERIES

    out = QUERIES["factor_weights"](spark, sf_dir).toPandas()
    for _, part in out.groupby("method"):
        assert abs(part["weight"].abs().sum() - 1) < 1e-4


def test_shrink_and_unit():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) @ np.array([[1.0, 0.5, 0.0], [0.0, 1.0, 0.3], [0.0, 0.0, 2.0]])
    c = x - x.mean(axis=0)
    cov = c.T @ c / 40
    # each observation's outer product against the covariance, term by term
    error = sum(((np.outer(r, r) - cov) ** 2).sum() for r in c) / 40**2
    level = np.trace(cov) / 3
    apart = ((cov - level * np.eye(3)) ** 2).sum()
    share = min(error, apart) / apart
    fourth = float((((c**2).sum(axis=1)) ** 2).mean())
    assert shrink(cov, 40, fourth) == pytest.approx((1 - share) * cov + share * level * np.eye(3))
    assert unit_l1(np.array([1.0, -3.0])) == pytest.approx([0.25, -0.75])
    assert unit_l1(np.zeros(4)) == pytest.approx(np.full(4, 0.25))


def test_weights_solve_the_shrunk_covariance(spark):
    rng = np.random.default_rng(6)
    ic = rng.normal(0.02, 0.1, size=(30, 3))
    rows = [(t, f"f{k}", float(ic[t, k])) for t in range(30) for k in range(3)]
    found = weights(spark.createDataFrame(rows, "ts int, name string, ic double"))
    c = ic - ic.mean(axis=0)
    cov = shrink(c.T @ c / 30, 30, float(((c**2).sum(axis=1) ** 2).mean())) + 1e-6 * np.eye(3)
    want = unit_l1(np.linalg.solve(cov, ic.mean(axis=0)))
    assert [found[f"f{k}"] for k in range(3)] == pytest.approx(want.tolist(), rel=1e-6)


def test_duplicate_groups_join_what_agrees():
    pairs = [("a", "b", 12, 1.0, 1.0), ("b", "d", 12, 0.9995, 0.995), ("a", "c", 12, 0.5, 0.1), ("e", "f", 9, 1.0, 1.0)]
    assert duplicate_groups(pairs) == [["a", "b", "d"]]


def test_parabolic_sar_by_hand():
    """Rising: stops 10, 10 (not above the last two lows), 10.08; then a low under the stop flips it to the extreme."""
    high, low = np.array([11.0, 12.0, 13.0, 12.5, 9.0]), np.array([10.0, 10.5, 11.5, 9.0, 8.0])
    out = parabolic_sar(high, low)
    # bar 1: 10 + .02 * (11 - 10) = 10.02, held to the low of bar 0 = 10; new high 12, speed .04
    # bar 2: 10 + .04 * (12 - 10) = 10.08; new high 13, speed .06. bar 3: 10.08 + .06 * 2.92 = 10.2552, held to the low 9, no touch
    # bar 4: 9 + .06 * (13 - 9) = 9.24, held to the low 8
    assert out == pytest.approx([10.0, 10.0, 10.08, 9.0, 8.0])


def test_kama_is_missing_after_a_window_without_movement():
    close = np.concatenate([np.arange(1.0, 14.0), np.full(12, 13.0), np.arange(14.0, 18.0)])
    out = kama(close)
    assert np.isnan(out[:10]).all() and out[10] == 11.0
    assert out[11] == pytest.approx(11.0 + (2 / 3) ** 2 * (12.0 - 11.0))  # a straight rise has ratio 1
    flat = 12 + 10  # ten differences of 0
    assert not np.isnan(out[flat - 1]) and np.isnan(out[flat:]).all()


def test_market_structure_by_hand():
    """Both kinds of swing have to end at a bar. Highs that end two rises: from the third bar on, the fifth has the first full window, each later one is a new
    maximum. Lows that end two falls: bars 2, 3, 6, 7, 8, the fifth with the first full window."""
    high = pd.Series([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0])
    low = pd.Series([0.9, 0.8, 0.3, 0.2, 0.9, 0.8, 0.7, 0.6, 0.5])
    assert market_structure(high, low).tolist() == [0.0] * 7 + [1.0, 1.0]
    assert market_structure(high, pd.Series([0.5] * 9)).tolist() == [0.0] * 9


def test_supertrend_starts_on_the_upper_band_and_changes_with_the_close():
    high, low = np.full(14, 11.0), np.full(14, 9.0)
    close = np.array([10.0] * 11 + [20.0, 20.0, 1.0])
    out = supertrend(high, low, close)
    assert np.isnan(out[:9]).all()
    assert out[9] == 10 + 3 * 2.0 and out[10] == 16.0  # range 2 for ten bars
    assert out[11] < 16.0  # the close is above the upper band: the lower one
    assert out[13] > 10.0  # below the lower band: the upper one


def test_greedy_skips_what_is_close_to_a_chosen_one():
    assert greedy({"a": 3.0, "b": 2.0, "c": 1.0}, {("a", "b"): 0.9, ("a", "c"): 0.1}, 5, 0.5) == ["a", "c"]
