"""Rank association against all pairs, whatever the ranges."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import association


def plain_tau(x, y) -> float:
    a, b = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    spread = np.sqrt((a != 0).sum() * float((b != 0).sum()))
    return float((a * b).sum() / spread) if spread else float("nan")


def test_weighted_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 129):
        y, w = rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n)
        assert association.inversions(y, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_kendall_with_ties_and_a_hot_value(spark, parts):
    rng = np.random.default_rng(2)
    frames = []
    for name, n in (("a", 400), ("b", 61), ("few", 7), ("flat", 30)):
        x = rng.integers(0, 30, n).astype(float)
        x[: n // 3] = 5.0  # a third of all rows share a value
        y = np.round(x * 0.2 + rng.normal(0, 3, n)) if name != "flat" else np.ones(n)
        frames.append(pd.DataFrame({"symbol": "s", "name": name, "value": x, "ret": y}))
    table = pd.concat(frames)
    odd = [("s", "a", None, 1.0), ("s", "a", float("nan"), 1.0), ("s", "b", 1.0, None)]
    rows = spark.createDataFrame([*table.itertuples(index=False, name=None), *odd], "symbol string, name string, value double, ret double")
    found = {r["name"]: r for r in association.kendall(rows, ["symbol", "name"], "value", "ret", parts=parts).collect()}
    for name, group in table.groupby("name"):
        assert found[name]["n"] == len(group)
        want = plain_tau(group["value"].to_numpy(), group["ret"].to_numpy())
        assert found[name]["kendall"] == (None if name in ("few", "flat") else pytest.approx(want, abs=1e-12))
    assert association.kendall(rows.limit(0), ["symbol", "name"], "value", "ret").count() == 0


def plain_information(x, y, k: int) -> float:
    """The estimate from all distances."""
    x, y = (np.floor(v / v.std() * association.GRAIN + 0.5).astype(np.int64) for v in (x, y))
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    psi = lambda n: -0.5772156649015329 + sum(1.0 / i for i in range(1, n))
    total = 0.0
    for i in range(len(x)):
        r = np.sort(np.delete(np.maximum(dx[i], dy[i]), i))[k - 1]
        total += psi(int((dx[i] <= max(r - 1, 0)).sum())) + psi(int((dy[i] <= max(r - 1, 0)).sum()))
    return max(0.0, psi(len(x)) + psi(k) - total / len(x))


@pytest.mark.parametrize("parts", [1, 7])
def test_feature_scores_with_copies_and_gaps(spark, parts):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for symbol, n in (("a", 230), ("b", 90), ("tiny", 3)):
        t = rng.normal(size=n)
        table = {"near": t + rng.normal(0, 0.3, n), "ring": t * t + rng.normal(0, 0.1, n), "noise": rng.normal(size=n), "flat": np.full(n, 2.0)}
        table["near"][: n // 3] = 0.0  # a third are copies
        for i in range(n):
            rows.append((symbol, *(None if c == "noise" and i == 5 else float(table[c][i]) for c in table), float(t[i])))
        if n > 5:
            table["noise"][5] = 0.0
        for c, x in table.items():
            if n > 3 and c != "flat":
                r = np.corrcoef(x, t)[0, 1]
                want[symbol, c] = (r * r / (1 - r * r) * (n - 2), plain_information(x, t, 3))
    frame = spark.createDataFrame(rows, "symbol string, near double, ring double, noise double, flat double, t double")
    scores = association.feature_scores(frame, ["symbol"], ["near", "ring", "noise", "flat"], "t", parts=parts).cache()
    found = {(r["symbol"], r["feature"]): r for r in scores.collect()}
    assert len(found) == 12
    for key, (f, mi) in want.items():
        assert found[key]["f_score"] == pytest.approx(f, rel=1e-6) and found[key]["mutual_information"] == pytest.approx(mi, abs=1e-6)
    assert found["a", "flat"]["f_score"] is None and found["tiny", "near"]["mutual_information"] is None
    best = association.select_features(scores, ["symbol"], "mutual_information", 2).filter("symbol = 'a'").orderBy("place").collect()
    assert [r["feature"] for r in best] == sorted(["near", "ring", "noise"], key=lambda c: -want["a", c][1])[:2]
