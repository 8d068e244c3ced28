"""Likeness of factors against pandas."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import similarity

NAMES = ["a", "b", "c", "flat", "rare"]


def made(n: int = 300) -> pd.DataFrame:
    rng = np.random.default_rng(11)
    a = rng.integers(0, 12, n).astype(float)
    t = pd.DataFrame({"a": a, "b": np.exp(a) + rng.normal(size=n), "c": rng.normal(size=n), "flat": 1.0, "rare": np.nan})
    t.loc[: n // 3, "a"] = 4.0  # a third shares a value
    t.loc[rng.choice(n, 60, False), "b"] = np.nan
    t.loc[rng.choice(n, 90, False), "c"] = np.nan
    t.loc[:6, "rare"] = np.arange(7.0)
    return t


@pytest.mark.parametrize("parts", [1, 9])
def test_pooled_correlations_equal_pandas(spark, parts):
    t = made()
    rows = [(f"s{i % 7}", i, c, None if np.isnan(x) else float(x)) for c in NAMES for i, x in enumerate(t[c])]
    rows += [("odd", 1, "a", float("nan")), ("odd", 1, "b", float("inf")), rows[3]]
    long = spark.createDataFrame(rows, "symbol string, ts int, name string, value double")
    found = {(r["a"], r["b"]): r for r in similarity.factor_likeness(long, NAMES, flipped=("b",), parts=parts).collect()}
    flip = t.assign(b=-t["b"])
    p, s = flip.corr(min_periods=10), flip.corr("spearman", min_periods=10)
    assert set(found) == {(x, y) for i, x in enumerate(NAMES[:4]) for y in NAMES[i + 1 : 4]}
    for (x, y), r in found.items():
        assert r["n"] == t[[x, y]].dropna().shape[0]
        for got, want in ((r["pearson"], p[x][y]), (r["spearman"], s[x][y])):
            assert got is None if np.isnan(want) else got == pytest.approx(want, abs=1e-9)
        assert r["alike"] == (max(abs(r["pearson"] or 0), abs(r["spearman"] or 0)) >= 0.7)
    assert found["a", "b"]["alike"] and found["a", "b"]["spearman"] < 0 and not found["a", "c"]["alike"]
    assert similarity.factor_likeness(long.limit(0), NAMES).count() == 0


@pytest.mark.parametrize("missing", [20, 75])
def test_ic_likeness_takes_common_dates_or_pairs(spark, missing):
    rng = np.random.default_rng(3)
    t = pd.DataFrame(rng.normal(size=(100, 3)), columns=list("xyz"))
    t.loc[:missing, "z"] = np.nan
    rows = [(i, c, float(v)) for c in t for i, v in enumerate(t[c]) if not np.isnan(v)]
    found = similarity.ic_likeness(spark.createDataFrame(rows, "ts int, name string, ic double"), list("xyz")).collect()
    whole = t.dropna()
    pairwise = len(whole) < 30
    want = t if pairwise else whole
    p, s = want.corr(min_periods=30), want.corr("spearman", min_periods=30)
    assert {(r["mode"], r["aligned"]) for r in found} == {("pairwise", 100) if pairwise else ("intersection", len(whole))}
    assert {(r["a"], r["b"]) for r in found} == ({("x", "y")} if pairwise else {("x", "y"), ("x", "z"), ("y", "z")})
    for r in found:
        assert r["pearson"] == pytest.approx(p[r["a"]][r["b"]]) and r["spearman"] == pytest.approx(s[r["a"]][r["b"]])
