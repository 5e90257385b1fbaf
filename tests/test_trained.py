"""The trained forecaster: gradients, early stop, restart, and a fixture that a
line can't forecast."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from enclima.operators import lagged, trained

SCHEMA = "series string, Data date, pos long, value double, e double"


def rows_of(n, seed=3):
    """A threshold process: the sign of the next step depends on where the series is."""
    rng = np.random.default_rng(seed)
    out = []
    for s in ("a", "b", "c", "d"):
        y = [0.1]
        for _ in range(n - 1):
            y.append(float(np.clip(1.6 - 1.9 * abs(y[-1]) + rng.normal(0, 0.02), -2, 2)))
        out += [(s, dt.date(2000, 1, 1) + dt.timedelta(days=i), i, v, float(i % 7)) for i, v in enumerate(y)]
    return out


def test_gradient_of_the_network():
    rng = np.random.default_rng(1)
    net = trained.Net.start(4, 2, 1, 3, 5)
    net.theta = rng.normal(size=len(net.theta)) * 0.3
    x, start = rng.normal(size=(30, 2)), np.arange(20)
    _, grad = net.gradient(x, start)
    for i in rng.integers(0, len(net.theta), 12):
        keep, eps = net.theta.copy(), 1e-6
        net.theta = keep.copy(); net.theta[i] += eps  # noqa: E702
        up = net.gradient(x, start)[0]
        net.theta = keep.copy(); net.theta[i] -= eps  # noqa: E702
        assert abs((up - net.gradient(x, start)[0]) / (2 * eps) - grad[i]) < 1e-3 * max(1, abs(grad[i]))
        net.theta = keep


def test_beats_the_linear_forecaster_and_restarts(spark, tmpdir_path):
    df = spark.createDataFrame(rows_of(260), SCHEMA).cache()
    part = {"train": df.where("pos < 180"), "valid": df.where("pos >= 176 AND pos < 215"), "test": df.where("pos >= 211")}
    how = dict(keys=["series"], pos="pos", value="value", context=4, horizon=1, hidden=16, epochs=12, steps=4, rate=0.1,
               patience=12, seed=11)
    whole, history = trained.fit(part["train"], part["valid"], path=f"{tmpdir_path}/whole", **how)
    assert len(history) == 12 and history[-1][1] < 0.5 * history[0][1]
    # stopped after five epochs and gone on from the written state, dealt otherwise
    trained.fit(part["train"].repartition(7), part["valid"], path=f"{tmpdir_path}/parts", stop_after=5, **how)
    again, resumed = trained.fit(part["train"], part["valid"], path=f"{tmpdir_path}/parts", **how)
    assert len(resumed) == 12 and np.allclose(again.theta, whole.theta, rtol=1e-6, atol=1e-8)

    models = lagged.fit_windows(part["train"], ["series"], "pos", "value", 4, 1)
    error = {}
    for name, kind in (("linear", "linear"), ("trained", whole)):
        got = lagged.forecast_mean(part["test"], ["series"], "pos", "value", 4, 1, kind, models if kind == "linear" else None)
        gap = got.join(df, ["series", "pos"]).agg(F.avg((F.col("value") - F.col("predicted")) ** 2)).first()[0]
        error[name] = gap
    assert error["trained"] < 0.5 * error["linear"]


def test_early_stop_returns_the_best_epoch(spark):
    df = spark.createDataFrame(rows_of(90), SCHEMA)
    noise = df.withColumn("value", F.rand(3))
    net, history = trained.fit(df, noise, ["series"], "pos", "value", 4, 2, exog=["e"], hidden=4, epochs=12, steps=1,
                               rate=0.1, patience=2)
    best = min(range(len(history)), key=lambda i: history[i][2])
    assert len(history) < 12 and best >= len(history) - 3
    empty = df.where("pos < 0")
    net, history = trained.fit(empty, empty, ["series"], "pos", "value", 4, 2, epochs=2, steps=1)
    assert len(history) == 2 and np.isfinite(net.theta).all()
