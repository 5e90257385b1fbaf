"""Locally weighted decomposition against plain numpy loops."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from enclima.operators.loess import decompose_loess, loess


def plain_loess(y, span, at, weight=None):
    n, half = len(y), (span - 1) // 2
    u = np.ones(n) if weight is None else weight
    out = []
    for x in at:
        if n <= span:
            left, right = 0, n - 1
        else:
            left = max(0, min(x - half, n - span))
            right = left + span - 1
        h = max(x - left, right - x) + max(span - n, 0) // 2
        j = np.arange(left, right + 1)
        r = np.abs(j - x)
        w = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / h) ** 3) ** 3, 0.0)) * u[j]
        w = w / w.sum()
        a = (w * j).sum()
        c = (w * (j - a) ** 2).sum()
        if math.sqrt(c) > 0.001 * (n - 1):
            w = w * (1 + (x - a) / c * (j - a))
        out.append((w * y[j]).sum())
    return np.array(out)


def plain_stl(y, p, span, inner, outer=0):
    n = len(y)
    odd = lambda v: (lambda k: k if k % 2 else k + 1)(int(math.ceil(v)))
    trend, rw = np.zeros(n), np.ones(n)
    for k in range(outer + 1):
        for _ in range(inner):
            c = np.zeros(n + 2 * p)
            for phase in range(p):
                sub = (y - trend)[phase::p]
                c[phase::p] = plain_loess(sub, span, range(-1, len(sub) + 1), rw[phase::p])[:len(c[phase::p])]
            m = c
            for width in (p, p, 3):
                m = np.convolve(m, np.ones(width) / width, "valid")
            seasonal = c[p:p + n] - plain_loess(m, odd(p + 1), range(n))
            trend = plain_loess(y - seasonal, odd(1.5 * p / (1 - 1.5 / span)), range(n), rw)
        if k < outer:
            r = np.abs(y - seasonal - trend)
            h = 6 * np.median(r)
            rw = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0.0))
    return seasonal, trend


def series(n, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 0.02 * t + np.sin(2 * np.pi * t / 12) * (1 + t / n) + 0.5 * np.sin(2 * np.pi * t / 4) + rng.normal(0, 0.2, n)
    y[n // 3] += 5
    return y


def frame(spark, many):
    rows = [(s, dt.date(2000 + i // 12, 1 + i % 12, 1), float(v)) for s, y in many.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "`the series` string, Data date, value double").repartition(3)


@pytest.mark.parametrize("n,span,inner,outer", [(75, 11, 2, 0), (150, 7, 1, 1)])
def test_one_period(spark, n, span, inner, outer):
    many = {"a": series(n, 1), "b": series(n, 2) * 3}
    out = decompose_loess(frame(spark, many), ["the series"], "Data", "value", [12], [span], inner, outer).collect()
    assert len(out) == 2 * n
    for s, y in many.items():
        seasonal, trend = plain_stl(y, 12, span, inner, outer)
        rows = sorted((r for r in out if r["the series"] == s), key=lambda r: r.Data)
        assert np.allclose([r.seasonal for r in rows], seasonal, atol=1e-9)
        assert np.allclose([r.trend for r in rows], trend, atol=1e-9)
        assert np.allclose([r.resid for r in rows], y - seasonal - trend, atol=1e-9)


def test_two_periods(spark):
    y = series(96, 4)
    out = decompose_loess(frame(spark, {"a": y}), ["the series"], "Data", "value", [12, 4], inner=1).collect()
    parts = {4: np.zeros(96), 12: np.zeros(96)}
    for _ in range(2):
        for p, span in ((4, 11), (12, 15)):
            rest = y - sum(v for q, v in parts.items() if q != p)
            parts[p], trend = plain_stl(rest, p, span, 1)
    rows = sorted(out, key=lambda r: r.Data)
    assert np.allclose([r.seasonal_4 for r in rows], parts[4], atol=1e-9)
    assert np.allclose([r.seasonal_12 for r in rows], parts[12], atol=1e-9)
    assert np.allclose([r.trend for r in rows], trend, atol=1e-9)


def test_missing_values_have_no_weight(spark):
    rows = [("a", i, None if i == 5 else float(2 * i + 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, pos long, v double")
    got = {r.pos: r.fit for r in loess(df, ["k"], "pos", F.col("v"), 7, F.lit(29), extend=1).collect()}
    assert set(got) == set(range(-1, 31))
    assert all(abs(v - (2 * x + 1)) < 1e-9 for x, v in got.items())        # a line is met, gap and ends included
