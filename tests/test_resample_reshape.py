"""Resampling and reshaping against pandas semantics (S2-S5, RSH-*, AGG-*)."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from enclima.functions import sum_or_zero
from enclima.operators import reshape, resample

T, D = dt.datetime, dt.date
SCHEMA = "ts timestamp_ntz, series string, value double"


def _pandas_resample(rows, rule, how):
    pdf = pd.DataFrame(rows, columns=["ts", "series", "value"])
    wide = pdf.pivot_table(index="ts", columns="series", values="value", aggfunc="sum", dropna=False)
    r = wide.resample(rule)
    return getattr(r, how)()


def _spark_dict(df, col="value"):
    return {(r["series"], r["Data"]): r[col] for r in df.collect()}


def _same(a, b):
    if a is None or (isinstance(a, float) and np.isnan(a)):
        return b is None or (isinstance(b, float) and np.isnan(b))
    return b is not None and abs(a - b) < 1e-9


ROWS = [
    (T(2024, 1, 1, 0), "a", 1.0), (T(2024, 1, 1, 1), "a", 2.0), (T(2024, 1, 1, 1), "a", 4.0),
    (T(2024, 1, 1, 2), "a", None),                      # missing inside a bin
    (T(2024, 1, 4, 5), "a", 3.0),                       # days 2 and 3 are whole missing bins
    (T(2024, 1, 2, 7), "b", None),                      # all-missing group
    (T(2024, 1, 9, 23), "b", 5.0), (T(2024, 2, 3, 0), "b", 7.0),
]


def test_dense_day_sum_mean_match_pandas(spark):
    # hourly cells follow pivot_table(aggfunc='sum'): all-missing hour -> 0 (S4)
    cells = spark.createDataFrame(ROWS, SCHEMA).groupBy("ts", "series").agg(sum_or_zero("value").alias("value"))
    for how in ("sum", "mean"):
        got = _spark_dict(resample.resample(cells, "ts", ["series"], "value", "day", how))
        exp = _pandas_resample(ROWS, "D", how)
        # pandas: an all-NaN pivot cell sums to 0 in the pivot (S4) - cells carry that rule
        assert len(got) == exp.shape[0] * exp.shape[1]
        for day, row in exp.iterrows():
            for s in exp.columns:
                assert _same(got[(s, day.date())], row[s]), (how, s, day)


def test_week_month_year_labels(spark):
    cells = spark.createDataFrame(ROWS, SCHEMA)
    wk = _spark_dict(resample.resample(cells, "ts", ["series"], "value", "week", "sum"))
    assert ("a", D(2024, 1, 7)) in wk and ("b", D(2024, 2, 4)) in wk   # Sunday labels (S5)
    assert wk[("a", D(2024, 1, 7))] == 10.0
    mo = _spark_dict(resample.resample(cells, "ts", ["series"], "value", "month", "mean"))
    assert set(d for _, d in mo) == {D(2024, 1, 31), D(2024, 2, 29)}     # month end (S6)
    yr = _spark_dict(resample.resample(cells, "ts", ["series"], "value", "year", "sum"))
    assert yr[("b", D(2024, 12, 31))] == 12.0


def test_partial_weeks_match_pandas(spark):
    rows = [(T(2024, 1, 3) + dt.timedelta(days=i), "a", float(i)) for i in range(20)]
    got = _spark_dict(resample.resample(spark.createDataFrame(rows, SCHEMA), "ts", ["series"], "value", "week", "mean"))
    exp = _pandas_resample(rows, "W", "mean")
    assert {d.date(): v for d, v in exp["a"].items()} == {d: v for (_, d), v in got.items()}


def test_23_hour_day_mean_is_mean_of_hours(spark):
    rows = [(T(2013, 10, 20, h), "a", float(h)) for h in range(23)]
    out = resample.resample_many(spark.createDataFrame(rows, SCHEMA), "ts", ["series"], "value", "day",
                                 ("sum", "mean", "count")).first()
    assert out["value_count"] == 23 and out["value_mean"] == sum(range(23)) / 23


def test_pivot_absent_null_all_missing_zero(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "y", 2.0), (2, "y", 3.0)], "ts int, key string, value double")
    w = {r["ts"]: r for r in reshape.pivot_series(df, "ts", "key", "value", prefix="P_").collect()}
    assert w[1]["P_x"] == 0.0 and w[2]["P_x"] is None and w[2]["P_y"] == 3.0


def test_grouping_sets_and_wide(spark):
    df = spark.createDataFrame([(1, "H", "N", 1.0), (1, "H", "S", 2.0), (1, "T", "N", 5.0), (2, "H", "N", None)],
                               "ts int, cls string, sub string, value double")
    sets = {(r.ts, r.cls, r.sub): r.value for r in reshape.class_subsystem_sets(df, "ts", "cls", "sub", "value").collect()}
    assert sets[(1, "H", None)] == 3.0 and sets[(1, "H", "S")] == 2.0 and sets[(2, "H", None)] == 0.0
    wide = {r.ts: r.asDict() for r in reshape.class_subsystem_wide(df, "ts", "cls", "sub", "value").collect()}
    assert wide[1]["H"] == 3.0 and wide[1]["T_N"] == 5.0 and wide[2]["T"] is None and wide[1]["T_S"] is None


def test_unpivot_pivot_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [(i, k, float(rng.normal())) for i in range(30) for k in ("a", "b", "c")]
    long = spark.createDataFrame(rows, "ts int, series string, value double")
    wide = reshape.pivot_series(long, "ts", "series", "value")
    back = reshape.unpivot_wide(wide, ["ts"])
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_multi_measure_and_union_by_name(spark):
    df = spark.createDataFrame([(1, "N", 1.0, 10.0), (1, "N", 2.0, None), (1, "S", None, None)],
                               "Data int, sub string, m1 double, m2 double")
    w = reshape.multi_measure_pivot(df, "Data", "sub", ["m1", "m2"]).first()
    assert w["N_m1"] == 3.0 and w["N_m2"] == 10.0 and w["S_m1"] == 0.0
    a = spark.createDataFrame([(1, "x")], "v int, k string")
    b = spark.createDataFrame([("y", 2, 0.5)], "k string, v int, extra double")
    u = reshape.union_by_name([a, b]).orderBy("v").collect()
    assert [tuple(r) for r in u] == [(1, "x", None), (2, "y", 0.5)]


def test_empty_input(spark):
    from enclima.operators import split
    empty = spark.createDataFrame([], SCHEMA)
    assert resample.resample(empty, "ts", ["series"], "value", "day", "sum").count() == 0
    assert reshape.pivot_series(empty, "ts", "series", "value", values=["a"]).count() == 0
    assert split.train_test_split(empty, "ts", 0.3).count() == 0


def test_hourly_dense_and_splits_are_time_zone_free(spark):
    from enclima.operators import split
    rows = [(T(2024, 3, 10, 1), "a", 1.0), (T(2024, 3, 10, 4), "a", 2.0)]   # a US DST night
    df = spark.createDataFrame(rows, SCHEMA)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        out = resample.resample(df, "ts", ["series"], "value", "hour", "sum").orderBy("Data").collect()
        assert [r.Data for r in out] == [T(2024, 3, 10, h) for h in (1, 2, 3, 4)]
        assert dict(resample.resample(df, "ts", ["series"], "value", "hour", "sum").dtypes)["Data"] == "timestamp_ntz"
        s = split.train_test_split(df, "ts", 0.5).orderBy("ts").collect()
        assert [r.split for r in s] == ["train", "test"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
