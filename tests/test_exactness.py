"""Windows longer than a bucket, absent patch sources, dotted names, missing
marks, least squares on raw calendar columns."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from enclima.operators import clean, climate, split
from enclima.operators.regress import LinearModel
from enclima.sources.csv_files import typed_measurements
from enclima.sources.index_text import parse_wide_lines


def series(spark, n, step=1, names=("a", "b")):
    start = dt.date(2015, 3, 1)
    rows = [(s, start + dt.timedelta(days=i * step), float(i * (1 + j))) for j, s in enumerate(names) for i in range(n)]
    return spark.createDataFrame(rows, "series string, Data date, value double")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("n,step,context,horizon", [(1300, 1, 512, 96), (420, 7, 90, 30), (420, 7, 180, 60)])
def test_bucketed_windows_equal_whole_series(spark, n, step, context, horizon):
    df = series(spark, n, step)
    cols = ["series", "origin", F.size("context").alias("c"), F.element_at("context", 1).alias("first"),
            F.element_at("horizon", -1).alias("last"), F.size("horizon").alias("h")]
    whole = split.context_windows(df, ["series"], "Data", "value", context, horizon)
    parts = split.context_windows(df, ["series"], "Data", "value", context, horizon, bucket=F.year("Data"))
    assert whole.count() == 2 * (n - context - horizon + 1)
    same(whole.select(*cols), parts.select(*cols))


def test_long_lags_and_gaps(spark):
    df = series(spark, 1500).where("NOT Data BETWEEN DATE'2016-02-01' AND DATE'2018-01-15'")
    df = df.unionByName(df.limit(0)).unionByName(df.where("series = 'a'").withColumn("series", F.lit(None).cast("string")))
    same(climate.add_lags(df, ["series"], "Data", "value", [1, 400]),
         climate.add_lags(df, ["series"], "Data", "value", [1, 400], bucket=F.year("Data")))
    same(climate.rolling_mean(df, ["series"], "Data", "value", 500),
         climate.rolling_mean(df, ["series"], "Data", "value", 500, bucket=F.month("Data") + 12 * F.year("Data")))


def test_patch_without_source_keeps_the_row(spark):
    df = series(spark, 3)
    p = spark.createDataFrame([(dt.date(2015, 3, 1), dt.date(2030, 1, 1)), (dt.date(2015, 3, 2), dt.date(2015, 3, 3))],
                              "target_date date, source_date date")
    got = {(r.series, r.Data.day): r.value for r in clean.patch_rows(df, "Data", p, ["series"]).collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 2.0, ("a", 3): 2.0, ("b", 1): 0.0, ("b", 2): 4.0, ("b", 3): 4.0}


def test_dotted_names(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 5.0)], "`NIN 1.2_sst` double, `NIN 3.4_sst` double")
    cols = df.columns
    assert [r.total for r in clean.row_total(df, cols).collect()] == [1.0, 8.0]
    assert [r["mean"] for r in clean.row_mean(df, cols).collect()] == [1.0, 4.0]
    assert df.agg(clean.missing_cells(df).alias("n")).first().n == 1
    assert clean.clamp_columns(df, cols).columns == cols


def test_missing_marks_become_null(spark):
    df = spark.createDataFrame([("2020-01-01", t) for t in ("1.5", "NaN", "NA", " ", "-nan", None)], "Data string, v string")
    assert [r.v for r in typed_measurements(df, "Data", "yyyy-MM-dd", ["v"]).collect()] == [1.5] + [None] * 5
    line = spark.createDataFrame([("x", "2001 " + " ".join(["NaN"] + ["2.0"] * 11))], "index string, line string")
    assert [r.value for r in parse_wide_lines(line).orderBy("Data").collect()] == [None] + [2.0] * 11


def test_least_squares_on_raw_calendar_columns(spark):
    rng = np.random.default_rng(4)
    days = np.arange(1500)
    stamps = [dt.date(2015, 1, 1) + dt.timedelta(days=int(d)) for d in days]
    load = 4e4 + 5e3 * rng.random(len(days))
    x = np.column_stack([[s.year for s in stamps], [s.month for s in stamps], [s.timetuple().tm_yday for s in stamps],
                         [(s.month + 2) // 3 for s in stamps], load, 2 * load + 5]).astype(float)
    y = 7 + x @ [0.5, 1.0, 0.1, -2.0, 0.4, 0.25] + rng.normal(size=len(days))
    df = spark.createDataFrame([tuple(map(float, [*r, t])) for r, t in zip(x, y)],
                               "a double, b double, c double, d double, e double, f double, y double")
    m = LinearModel.fit(df, list("abcdef"), ["y"])
    xc = x - x.mean(0)
    want = np.linalg.lstsq(xc, y - y.mean(), rcond=None)[0]
    assert np.allclose(m.coef[:, 0], want, rtol=1e-6, atol=1e-6)
    pred = np.array([r.y_pred for r in m.predict(df).collect()])
    assert abs(np.sort(pred) - np.sort(y.mean() + xc @ want)).max() < 1e-6


def test_decompose_refuses_other_periods(spark):
    with pytest.raises(ValueError):
        climate.decompose(series(spark, 30), ["series"], "Data", "value", period=7)
