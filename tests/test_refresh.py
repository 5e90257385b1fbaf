"""Incremental refresh: late, repeated and replayed files equal a full rebuild."""
import datetime as dt
import os

from pyspark.sql import functions as F

from enclima.streaming.refresh import apply_batch, refresh

SCHEMA = "ts timestamp_ntz, sub string, value double"


def put(spark, folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    spark.createDataFrame(rows, SCHEMA).toPandas().to_csv(f"{folder}/{name}", index=False, sep=";")


def rows(year, months, value):
    return [(dt.datetime(year, m, d, h), s, None if d == 3 and s == "N" else value * m + h) for m in months for d in (1, 3, 28)
            for h in (0, 12) for s in ("N", "S")]


def tables(spark, root):
    return {t: sorted(map(str, spark.read.parquet(f"{root}/t/{t}").select("series", "Data", "total", "n").collect()))
            for t in ("daily", "monthly")}


def test_late_and_repeated_files(spark, tmpdir_path):
    root = tmpdir_path

    def run(at="in", to="t"):
        return refresh(spark, f"{root}/{at}/*", SCHEMA, f"{root}/{to}", f"{root}/ck-{to}",
                       lambda d: d.withColumnRenamed("sub", "series"), "csv", {"sep": ";", "header": "true"})

    put(spark, f"{root}/in/0", "g_2020.csv", rows(2020, range(1, 13), 1.0))
    put(spark, f"{root}/in/0", "g_2021_01.csv", rows(2021, [1], 5.0)[:3])               # not complete yet
    assert [m for _, m in run()] == [[202001 + i for i in range(12)] + [202101]]
    untouched = os.stat(f"{root}/t/daily/month=202005").st_mtime_ns
    put(spark, f"{root}/in/1", "g_2021_01.csv", rows(2021, [1], 7.0))                    # the same period, whole
    put(spark, f"{root}/in/1", "g_2019_12.csv", rows(2019, [12], 3.0))                   # late
    assert [m for _, m in run()] == [[201912, 202101]]
    assert os.stat(f"{root}/t/daily/month=202005").st_mtime_ns == untouched
    assert run() == []

    whole = rows(2020, range(1, 13), 1.0) + rows(2021, [1], 7.0) + rows(2019, [12], 3.0)
    df = spark.createDataFrame(whole, "ts timestamp_ntz, series string, value double")
    want = df.groupBy("series", F.to_date("ts").alias("Data")).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("value").alias("n"))
    got = tables(spark, root)
    assert got["daily"] == sorted(map(str, want.collect()))
    month = want.groupBy("series", F.last_day("Data").alias("Data")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    assert got["monthly"] == sorted(map(str, month.collect()))

    # a replayed batch changes nothing; of two files of one name the later counts
    again = spark.createDataFrame([(*r, "g_2021_01.csv", dt.datetime(2021, 2, 1 + (v != 7.0))) for v in (9.0, 7.0)
                                   for r in rows(2021, [1], v)], "ts timestamp_ntz, series string, value double, file string, "
                                                                "modified timestamp")
    assert apply_batch(again, f"{root}/t") == [202101]
    nine = tables(spark, root)
    assert nine["daily"] != got["daily"]
    assert apply_batch(again.where("modified < '2021-02-02'"), f"{root}/t") == [202101]
    assert apply_batch(again.where("modified < '2021-02-02'"), f"{root}/t") == [202101]
    assert tables(spark, root) == got
    assert apply_batch(again.where("file IS NULL"), f"{root}/t") == []
