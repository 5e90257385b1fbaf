"""Splits, windows, forecasts, regressions and scores (WIN-6..10, FCS, REG, EVL)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from enclima.operators import align, evaluate, forecast, split
from enclima.operators.regress import LinearModel, random_forest

D = dt.date


def _days(spark, n, series=("a",), f=lambda i: float(i)):
    rows = [(s, D(2020, 1, 1) + dt.timedelta(days=i), f(i)) for s in series for i in range(n)]
    return spark.createDataFrame(rows, "series string, Data date, value double")


def test_train_test_split_float_ceil(spark):
    df = _days(spark, 10)
    s = [r.split for r in split.train_test_split(df, "Data", 0.3).orderBy("Data").collect()]
    n_test = math.ceil(0.3 * 10)                       # 4 with float arithmetic, as sklearn
    assert s == ["train"] * (10 - n_test) + ["test"] * n_test


def test_fraction_splits_overlap_and_order(spark):
    df = _days(spark, 100)
    sp = split.fraction_splits(df, "Data", context=5).collect()
    by = {}
    for r in sp:
        by.setdefault(r.split, []).append(r.Data)
    assert len(by["train"]) == 70 and len(by["valid"]) == 10 + 5 and len(by["test"]) == 20 + 5
    assert max(by["train"]) < min(by["test"]) + dt.timedelta(days=5)
    assert min(by["valid"]) == D(2020, 1, 1) + dt.timedelta(days=65)


def test_time_series_folds_never_look_ahead(spark):
    n, k = 20, 5
    f = split.time_series_folds(_days(spark, n), "Data", k).collect()
    size = n // (k + 1)
    for i in range(k):
        tr = sorted(r.Data for r in f if r.fold == i and r.role == "train")
        te = sorted(r.Data for r in f if r.fold == i and r.role == "test")
        start = n - (k - i) * size
        assert len(tr) == start and len(te) == size and max(tr) < min(te)


def test_context_windows_keep_null_slots(spark):
    df = _days(spark, 12, ("a", "b"), f=lambda i: None if i == 5 else float(i))
    w = split.context_windows(df, ["series"], "Data", "value", 4, 2)
    assert w.count() == 2 * (12 - 4 - 2 + 1)
    row = w.where((F.col("series") == "a") & (F.col("origin") == D(2020, 1, 7))).first()
    assert [s.v for s in row.context] == [3.0, 4.0, None, 6.0] and [s.v for s in row.horizon] == [7.0, 8.0]


def test_naive_seasonal_explode_overlap(spark):
    w = split.context_windows(_days(spark, 20), ["series"], "Data", "value", 7, 3)
    nv = forecast.explode_forecasts(forecast.naive(w, 3), ["series"])
    r = nv.where(F.col("origin") == D(2020, 1, 10)).orderBy("step").collect()
    assert [(x.step, x.Data, x.predicted) for x in r] == [(s, D(2020, 1, 10 + s), 9.0) for s in (1, 2, 3)]
    se = forecast.explode_forecasts(forecast.seasonal(w, 3, 7), ["series"])
    r = se.where(F.col("origin") == D(2020, 1, 10)).orderBy("step").collect()
    assert [x.predicted for x in r] == [3.0, 4.0, 5.0]          # same weekday one week earlier
    om = {x.Data: (x.predicted, x.n_forecasts) for x in forecast.overlap_mean(nv, ["series"]).collect()}
    assert om[D(2020, 1, 12)] == (np.mean([8.0, 9.0, 10.0]), 3)


def test_linear_forecaster_recovers_trend(spark):
    w = split.context_windows(_days(spark, 60, ("a", "b"), f=lambda i: 2.0 * i + 1), ["series"], "Data", "value", 5, 3)
    models = forecast.fit_linear(w, ["series"], 5, 3, ridge=0.0)
    fc = forecast.explode_forecasts(forecast.linear(w, ["series"], models, 3), ["series"])
    truth = fc.join(_days(spark, 60, ("a", "b"), f=lambda i: 2.0 * i + 1), ["series", "Data"])
    assert max(abs(r.predicted - r.value) for r in truth.collect()) < 1e-6


def test_linear_model_matches_lstsq_min_norm(spark):
    rng = np.random.default_rng(0)
    x1 = rng.normal(size=50)
    X = np.column_stack([x1, 2 * x1, rng.normal(size=50)])          # collinear pair
    Y = np.column_stack([3 + X @ [1.0, 0.5, -2.0], -1 + X @ [0.0, 0.0, 4.0]]) + rng.normal(scale=0.1, size=(50, 2))
    rows = [tuple(map(float, list(X[i]) + list(Y[i]))) for i in range(50)]
    df = spark.createDataFrame(rows, "`f.1` double, f2 double, f3 double, y1 double, y2 double")
    m = LinearModel.fit(df, ["f.1", "f2", "f3"], ["y1", "y2"])
    Xc, Yc = X - X.mean(0), Y - Y.mean(0)
    coef = np.linalg.lstsq(Xc, Yc, rcond=None)[0]
    assert np.allclose(m.coef, coef, atol=1e-8)
    assert np.allclose(m.intercept, Y.mean(0) - X.mean(0) @ coef, atol=1e-8)
    pred = m.predict(df).select("y1_pred").collect()
    assert abs(pred[0][0] - (m.intercept[0] + X[0] @ m.coef[:, 0])) < 1e-9


def test_random_forest_learns_step(spark):
    rows = [(float(i), 0.0 if i < 50 else 10.0) for i in range(100)]
    df = spark.createDataFrame(rows, "`x.a` double, y double")
    fm = random_forest(df, ["x.a"], "y", num_trees=10, max_depth=3, feature_subset="all", seed=69)
    p = {r["x.a"]: r.prediction for r in fm.transform(df).collect()}
    assert p[5.0] < 2 and p[95.0] > 8


def test_metrics_formulas(spark):
    y, p = np.array([1.0, 2.0, 4.0, 7.0]), np.array([1.5, 2.0, 3.0, 8.0])
    df = spark.createDataFrame([("t", float(a), float(b)) for a, b in zip(y, p)], "target string, actual double, predicted double")
    m = evaluate.with_adjusted_r2(evaluate.regression_metrics(df, ["target"], "actual", "predicted"), 4, 1).first()
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(m.r2 - r2) < 1e-12 and abs(m.mse - ((y - p) ** 2).mean()) < 1e-12
    assert abs(m.adj_r2 - (1 - (1 - r2) * 3 / 2)) < 1e-12
    const = spark.createDataFrame([("c", 1.0, 1.0), ("c", 1.0, 2.0)], "target string, actual double, predicted double")
    assert evaluate.regression_metrics(const, ["target"], "actual", "predicted").first().r2 == 0.0


def test_model_delta_published_matrix(spark):
    # random forest as +1.37 %
    mse = {"linear": 2.22e7, "forest": 2.19e7, "oneshot": 1.87e7, "finetune": 1.47e7}
    df = spark.createDataFrame([("hydro", k, v) for k, v in mse.items()], "source string, model string, mse double")
    d = {(r.model_a, r.model_b): r.delta_pct for r in align.model_delta(df, list(mse)).collect()}
    assert len(d) == 12
    assert abs(d[("linear", "forest")] - 1.37) < 0.01
    assert abs(d[("oneshot", "finetune")] - 100 * (1.87 - 1.47) / 1.47) < 1e-9


def test_month_mean_and_pairs(spark):
    df = _days(spark, 40).withColumn("predicted", F.col("value") + 1)
    m = {r.Data: (r.value, r.predicted) for r in evaluate.month_mean(df, ["series"], "Data", ["value", "predicted"]).collect()}
    assert m[D(2020, 1, 31)] == (15.0, 16.0)
    p = evaluate.pairs_table(df, ["series"], "Data", "value", "predicted")
    assert p.columns == ["series", "Data", "split", "actual", "predicted"]


def test_bucketed_windows_equal_whole_series(spark):
    from enclima.operators import climate
    df = _days(spark, 800, ("a", "b"), f=lambda i: float((i * 37) % 101))
    yr = F.year("Data")
    whole = split.context_windows(df, ["series"], "Data", "value", 30, 7)
    buck = split.context_windows(df, ["series"], "Data", "value", 30, 7, bucket=yr)
    key = lambda r: (r.series, r.origin, tuple(s.v for s in r.context), tuple(s.v for s in r.horizon))
    assert sorted(map(key, whole.collect())) == sorted(map(key, buck.collect()))
    r1 = climate.rolling_mean(df, ["series"], "Data", "value", 3, out="r")
    r2 = climate.rolling_mean(df, ["series"], "Data", "value", 3, out="r", bucket=yr)
    assert sorted(map(tuple, r1.collect())) == sorted(map(tuple, r2.select(*r1.columns).collect()))
    l1 = climate.add_lags(df, ["series"], "Data", "value", [1, 15])
    l2 = climate.add_lags(df, ["series"], "Data", "value", [1, 15], bucket=yr)
    assert sorted(map(tuple, l1.collect())) == sorted(map(tuple, l2.select(*l1.columns).collect()))
