"""Scan of the latest bars against pandas."""

import datetime

import numpy as np
import pandas as pd
import pytest

from barloom.operators import scan

SCHEMA = "symbol string, ts timestamp_ntz, name string, value double"
DAY = datetime.datetime(2024, 1, 1)


def rows_of(seed: int = 5):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(40):
        for name in ("a", "b", "c"):
            for t in range(3):
                rows.append((f"s{s:02d}", DAY + datetime.timedelta(days=t), name, float(rng.integers(-5, 6)) if s % 9 else float(rng.normal() * 50)))
    rows += [("s03", DAY + datetime.timedelta(days=9), "a", None), ("s04", DAY + datetime.timedelta(days=9), "b", float("inf")), ("solo", DAY, "only", 1.0), ("old", DAY - datetime.timedelta(days=90), "a", 2.0)]
    return rows


def plain(rows, directions, normalise, outlier):
    t = pd.DataFrame(rows, columns=["symbol", "ts", "name", "value"]).sort_values("ts", kind="stable")
    last = t.groupby(["symbol", "name"]).tail(1)
    last = last[np.isfinite(last["value"].astype(float))]
    out = {}
    for name, g in last.groupby("name"):
        v = g["value"].to_numpy(float)
        if len(v) < 2:
            continue
        if outlier == "mad":
            m = np.median(v)
            d = np.median(abs(v - m))
            v = np.clip(v, m - 3 * d, m + 3 * d) if d > 0 and len(v) >= 3 else v
        elif outlier == "winsor":
            v = np.clip(v, np.quantile(v, 0.01), np.quantile(v, 0.99))
        share = (pd.Series(v).rank().to_numpy() - 1) / (len(v) - 1)
        score = {"rank": share, "rank_centered": 2 * share - 1, "raw": v}[normalise]
        if directions.get(name) == -1:
            score = 1 - score if normalise == "rank" else -score
        for s, x, p in zip(g["symbol"], score, pd.Series(v).rank(ascending=False).astype(int), strict=True):
            out[s, name] = (float(x), int(p), len(v))
    return out


@pytest.mark.parametrize("normalise,outlier,parts", [("rank_centered", "mad", 1), ("rank", "winsor", 5), ("raw", "none", 3), ("raw", "mad", None)])
def test_scores_and_composite(spark, normalise, outlier, parts):
    rows, directions, weights = rows_of(), {"b": -1}, {"a": 2.0, "b": -1.0, "c": 0.5}
    latest = scan.latest_values(spark.createDataFrame(rows, SCHEMA))
    scores = scan.factor_scores(latest, directions, normalise, outlier, parts=parts)
    found = {(r["symbol"], r["name"]): (r["score"], r["place"], r["coverage"]) for r in scores.collect()}
    want = plain(rows, directions, normalise, outlier)
    assert set(found) == set(want) and ("solo", "only") not in found and ("s03", "a") not in found
    for key, (score, place, n) in want.items():
        assert found[key][0] == pytest.approx(score, abs=1e-12) and found[key][1:] == (place, n)
    for given in (weights, None, {n: 0.0 for n in "abc"}):
        total = {}
        for (s, n), (x, _, _) in want.items():
            total.setdefault(s, []).append((x, 1.0 if not given or not any(given.values()) else given[n]))
        both = {s: sum(x * w for x, w in v) / sum(abs(w) for _, w in v) for s, v in total.items()}
        got = {r["symbol"]: r["score"] for r in scan.composite(scores, given).collect()}
        assert got == pytest.approx(both, abs=1e-12)


def test_best_and_worst_with_ties_and_few_symbols(spark):
    scored = spark.createDataFrame([(f"s{i}", 1, float(i // 2)) for i in range(9)], "symbol string, factors long, score double")
    found = [(r["side"], r["place"], r["symbol"]) for r in scan.best_and_worst(scored, 3, 2).collect()]
    assert found == [("long", 1, "s8"), ("long", 2, "s6"), ("long", 3, "s7"), ("short", 1, "s1"), ("short", 2, "s0")]
    assert scan.best_and_worst(scored, 50, 0).count() == 9 and scan.best_and_worst(scored.limit(0), 3, 3).count() == 0


def test_stale_symbols_and_nothing(spark):
    long = spark.createDataFrame(rows_of(), SCHEMA)
    assert scan.latest_values(long, fresh_from=DAY).filter("symbol = 'old'").count() == 0
    assert scan.latest_values(long).filter("symbol = 'old'").count() == 1
    assert scan.factor_scores(scan.latest_values(long.limit(0))).count() == 0
