"""Window models without windows against models on formed windows."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from enclima.operators import forecast, lagged, split


def rows_of(n, seed, gaps=(), nulls=()):
    rng = np.random.default_rng(seed)
    y = np.cumsum(rng.normal(size=n)) * 0.1 + np.sin(np.arange(n) / 5)
    e1, e2 = rng.normal(size=n), np.roll(y, -2) + rng.normal(size=n) * 0.1
    out = []
    for s in ("a", "b"):
        for i in range(n):
            if i in gaps:
                continue
            v = None if i in nulls else float(y[i] + (s == "b") * rng.normal())
            out.append((s, dt.date(2000, 1, 1) + dt.timedelta(days=i), i, v, float(e1[i]), float(e2[i])))
    return out


SCHEMA = "series string, Data date, pos long, value double, `e.1` double, e2 double"


def plain(rows, context, horizon, exog, ridge):
    """Per series: weights and intercepts from formed windows."""
    out = {}
    for s in ("a", "b"):
        at = {r[2]: r for r in rows if r[0] == s}
        x, y = [], []
        for start in range(max(at) + 1):
            win = [at.get(start + i) for i in range(context + horizon)]
            if any(r is None or r[3] is None for r in win):
                continue
            x.append([r[3] for r in win[:context]] + [r[4 + c] for c in exog for r in win[context:]])
            y.append([r[3] for r in win[context:]])
        x, y = np.array(x), np.array(y)
        xc, yc = x - x.mean(0), y - y.mean(0)
        w = np.linalg.solve(xc.T @ xc + ridge * len(x) * np.eye(x.shape[1]), xc.T @ yc)
        out[s] = (len(x), w.T, y.mean(0) - x.mean(0) @ w)
    return out


@pytest.mark.parametrize("block,gaps,nulls", [(8192, (), ()), (16, (), ()), (16, (70, 71, 120), (33, 95)), (10, (48,), (64,))])
def test_models_as_from_formed_windows(spark, monkeypatch, block, gaps, nulls):
    monkeypatch.setattr(lagged, "_block_rows", lambda width: block)
    rows = rows_of(160, 3, gaps, nulls)
    df = spark.createDataFrame(rows, SCHEMA)
    for exog, cols in (((), []), ((0, 1), ["e.1", "e2"])):
        got = {r.series: r for r in lagged.fit_windows(df, ["series"], "pos", "value", 6, 3, cols, [1e-2]).collect()}
        for s, (n, w, b) in plain(rows, 6, 3, exog, 1e-2).items():
            assert got[s].n == n
            assert np.allclose(np.array(got[s]._w).reshape(3, -1), w, atol=1e-8)
            assert np.allclose(got[s]._b, b, atol=1e-8)


@pytest.mark.parametrize("block", [8192, 12])
def test_forecasts_as_from_formed_windows(spark, monkeypatch, block):
    monkeypatch.setattr(lagged, "_block_rows", lambda width: block)
    rows = rows_of(90, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    w = split.context_windows(df, ["series"], "Data", "value", 8, 4, exog=["e2"])
    models = forecast.fit_linear(w, ["series"], 8, 4, exog=F.col("exog_horizon"), n_exog=4, ridge=1e-2)
    fresh = lagged.fit_windows(df, ["series"], "pos", "value", 8, 4, ["e2"], [1e-2])
    formed = {"naive": forecast.naive(w, 4), "seasonal": forecast.seasonal(w, 4, 7),
              "linear": forecast.linear(w, ["series"], models, 4, exog=F.col("exog_horizon"))}
    for kind, f in formed.items():
        want = {(r.series, r.Data): (r.predicted, r.n_forecasts)
                for r in forecast.overlap_mean(forecast.explode_forecasts(f, ["series"]), ["series"]).collect()}
        got = lagged.forecast_mean(df, ["series"], "pos", "value", 8, 4, kind, fresh,
                                   ["e2"] if kind == "linear" else [], season=7)
        got = {(r.series, dt.date(2000, 1, 1) + dt.timedelta(days=r.pos)): (r.predicted, r.n_forecasts) for r in got.collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-7


def test_origins_and_missing_values(spark):
    rows = rows_of(40, 7, gaps=(20,), nulls=(10,))
    df = spark.createDataFrame(rows, SCHEMA)
    got = lagged.forecast_mean(df, ["series"], "pos", "value", 4, 2, "naive", origins=F.col("pos") >= 25).collect()
    # origins 25 .. 37 with the four rows before them
    assert {r.pos for r in got} == set(range(26, 40)) and {r.n_forecasts for r in got} == {1, 2}
    some = lagged.forecast_mean(df, ["series"], "pos", "value", 4, 2, "naive").where("series = 'a'").collect()
    assert 21 not in {r.pos for r in some} and 22 not in {r.pos for r in some}    # no context around the gap
