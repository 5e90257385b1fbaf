"""Property tests from the survey's test strategy."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from enclima.operators import resample
from enclima.plans import flows

T = dt.datetime
rows_strategy = st.lists(
    st.tuples(st.integers(0, 24 * 40 - 1), st.sampled_from(["a", "b", "c"]),
              st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False).map(lambda x: round(x, 2)))),
    min_size=1, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy)
def test_resample_preserves_totals_and_spans_days(spark, rows):
    data = [(T(2020, 1, 1) + dt.timedelta(hours=h), s, v) for h, s, v in rows]
    df = spark.createDataFrame(data, "ts timestamp_ntz, series string, value double")
    d = resample.resample(df, "ts", ["series"], "value", "day", "sum").collect()
    total = sum(v for _, _, v in data if v is not None)
    assert abs(sum(r.value for r in d) - total) < 1e-6
    days = {t.date() for t, _, _ in data}
    span = (max(days) - min(days)).days + 1
    assert len(d) == span * len({s for _, s, _ in data})
    m = resample.resample(df, "ts", ["series"], "value", "month", "sum").collect()
    assert abs(sum(r.value for r in m) - total) < 1e-6


def test_year_shares_sum_to_100(spark):
    data = [(T(2000 + i % 3, 1 + i % 12, 1), k, float(i + 1)) for i in range(60) for k in ("x", "y")]
    df = spark.createDataFrame(data, "ts timestamp_ntz, cls string, value double")
    y = resample.resample(df, "ts", ["cls"], "value", "year", "sum", dense=False)
    share = y.withColumn("p", 100 * F.col("value") / F.sum("value").over(Window.partitionBy("Data")))
    for r in share.groupBy("Data").agg(F.sum("p").alias("t")).collect():
        assert abs(r.t - 100) < 1e-9


def test_load_tables_mwh_over_mwmed_is_hours(spark):
    hours = [T(2013, 10, 1) + dt.timedelta(hours=h) for h in range(24 * 31 - 1)]   # a 743-hour October
    data = [(t, s, 1000.0 + (h % 7)) for h, t in enumerate(hours) for s in ("N", "S")]
    tabs = flows.load_tables(spark.createDataFrame(data, "ts timestamp_ntz, sub string, value double"))
    mwh = {(r.series, r.Data): r.value for r in tabs["monthly_MWh"].collect()}
    med = {(r.series, r.Data): r.value for r in tabs["monthly_MWmed"].collect()}
    for k in mwh:
        assert abs(mwh[k] / med[k] - 743) < 1e-9
