"""Principal components and rolling weights against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import rolling_weights, selection, spectral, walk_forward


def test_principal_components_of_groups(spark):
    rng = np.random.default_rng(3)
    frames = []
    for symbol, n in (("a", 300), ("b", 40), ("one", 1)):
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) * [1, 50, 0.01, 3] + [0, 1e7, 5, -2]
        frames.append(pd.DataFrame(x, columns=list("wxyz")).assign(symbol=symbol, ts=range(n), flat=7.0))
    table = pd.concat(frames)
    table.loc[table["ts"] == 3, "w"] = None
    rows = spark.createDataFrame(table.astype(object).where(table.notna(), None).to_dict("records"), "symbol string, ts bigint, w double, x double, y double, z double, flat double").repartition(5)
    scores, axes = spectral.principal_components(rows, ["symbol"], ["w", "x", "y", "z", "flat"], 3, ["ts"])
    scores, axes = scores.toPandas(), axes.toPandas()
    assert set(axes["symbol"]) == {"a", "b"} and len(scores) == 340
    for symbol in "ab":
        x = table[table["symbol"] == symbol][["w", "x", "y", "z", "flat"]].fillna(0.0).to_numpy()
        sd = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
        values, vectors = np.linalg.eigh(np.cov(z.T))
        mine = axes[axes["symbol"] == symbol].sort_values("component")
        assert mine["share"].to_numpy() == pytest.approx(values[::-1][:3] / values.sum(), abs=1e-9)
        got = scores[scores["symbol"] == symbol].sort_values("ts")[[f"pca_component_{i}" for i in (1, 2, 3)]].to_numpy()
        want = z @ vectors[:, ::-1][:, :3]
        want *= np.sign((got * want).sum(axis=0))
        assert got == pytest.approx(want, abs=1e-6)
    whole, _ = spectral.principal_components(rows, [], ["x", "y"], 2, ["ts"])
    assert whole.count() == 341


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(9)
    n = 150
    ret = rng.normal(size=n)
    table = pd.DataFrame({"f": ret + rng.normal(size=n), "g": rng.normal(size=n), "h": -0.3 * ret + rng.normal(size=n), "ret": ret, "ts": range(n), "symbol": "a"})
    table.loc[5:40, "g"] = None
    table.loc[10, ["f", "g", "h"]] = None
    table.loc[20, "ret"] = None
    table.loc[100:101, "h"] = np.nan
    return table


def frame_of(spark, table):
    return spark.createDataFrame(table.astype(object).where(table.notna(), None).to_dict("records"), "symbol string, ts bigint, f double, g double, h double, ret double")


def plain_matrix(table) -> pd.DataFrame:
    names = ["f", "g", "h"]
    aligned = table.dropna(subset=["ret"])[lambda d: d[names].notna().sum(axis=1) >= 1].reset_index(drop=True)
    rows, at = [], []
    for end in range(20, len(aligned) + 1):
        part = aligned.iloc[max(0, end - 60) : end]
        rows.append([part[n].corr(part["ret"]) for n in names])
        at.append(aligned["ts"].iloc[end - 1])
    out = pd.DataFrame(rows, columns=names, index=at)
    return out.fillna(out.median()).fillna(0.0)


def test_rolling_matrix_and_weights_of_every_date(spark, series):
    names = ["f", "g", "h"]
    short = series.head(30).assign(symbol="short")
    ic = rolling_weights.rolling_ic_matrix(frame_of(spark, pd.concat([series, short])), names).cache()
    found, want = ic.toPandas().sort_values("ts"), plain_matrix(series)
    assert set(found["symbol"]) == {"a"} and found["ts"].tolist() == want.index.tolist()
    assert found[names].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-9)
    for history in (None, 40):
        mine = rolling_weights.icir_weights(ic, names, history).toPandas().sort_values("ts")
        for row in (0, 1, 4, 60, len(want) - 1):
            past = want.iloc[: row + 1].tail(history or 10**9).to_numpy()
            centred = past - past.mean(axis=0)
            cov = centred.T @ centred / len(past)
            shrunk = selection.shrink(cov, len(past), float(((centred**2).sum(axis=1) ** 2).mean())) + 1e-6 * np.eye(3)
            expected = selection.unit_l1(np.linalg.solve(shrunk, past.mean(axis=0))) if len(past) > 1 else np.full(3, 1 / 3)
            assert mine.iloc[row]["n"] == len(past) and mine.iloc[row][names].to_numpy(float) == pytest.approx(expected, abs=1e-5)
    weights = rolling_weights.icir_weights(ic, names)
    made = rolling_weights.weighted_factor(frame_of(spark, series), weights, names).toPandas()
    assert made["ts"].min() == want.index[0] and len(made) == 150 - want.index[0]


def test_student_probabilities():
    known = [(2.0, 10, 0.073388035), (1.0, 1, 0.5), (0.0, 5, 1.0), (-2.7764451052, 4, 0.05), (12.7062047364, 1, 0.05), (1.9718962236, 200, 0.05)]
    for t, freedom, p in known:
        assert walk_forward.two_sided_p(t, freedom) == pytest.approx(p, rel=1e-4)


def test_ics_of_several_weightings_are_computed_once(spark):
    """An accumulator counts how often the rows behind the ICs are worked out."""
    import pandas as pd
    from pyspark.sql import functions as F

    from barloom.operators.selection import all_weights

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    rows = spark.createDataFrame([(t, n, 0.01 * ((t * k) % 7) - 0.02) for t in range(30) for k, n in ((3, "a"), (5, "b"))], "ts int, name string, ic double")
    found = all_weights(rows.withColumn("ic", counted("ic")), ("equal", "mean_ic", "max_icir"))
    assert seen.value == 60
    assert set(found) == {"equal", "mean_ic", "max_icir"} and found["equal"] == {"a": 0.5, "b": 0.5}


def test_daily_rank_ic_takes_average_ranks_of_ties(spark):
    import pandas as pd

    from barloom.operators.selection import daily_rank_ic

    rows = [(t, n, float((i * k + t) % 4), float((i * 3 + t) % 5)) for t in range(3) for k, n in ((1, "a"), (7, "b")) for i in range(20)]
    table = pd.DataFrame(rows, columns=["ts", "name", "value", "ret"])
    found = {(r["ts"], r["name"]): r["ic"] for r in daily_rank_ic(spark.createDataFrame(table)).collect()}
    for key, day in table.groupby(["ts", "name"]):
        assert abs(found[key] - day["value"].rank().corr(day["ret"].rank())) < 1e-12
