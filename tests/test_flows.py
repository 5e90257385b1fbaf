"""End-to-end flows against pandas / numpy on small fixtures (PIP-1, PIP-2,
PIP-6, PIP-7, PIP-8, PIP-9)."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from enclima.dims import FUEL_CLASS, patches_df
from enclima.plans import flows

T = dt.datetime


def _generation_rows():
    rows = []
    for h in range(0, 24 * 5, 3):
        t = T(2013, 11, 29) + dt.timedelta(hours=h)
        rows.append((t, "SE", "Gás", 10.0 + h))
        rows.append((t, "SE", "Hidráulica", 100.0 + h))
        if h % 2 == 0:
            rows.append((t, "N", "Biomassa", 1.0))
    rows.append((T(2013, 11, 30, 1), "S", "Eólica", None))          # all-missing group
    rows.append((T(2013, 11, 30, 1), "SE", "Carvão", 5.0))          # duplicate (time, class, sub)
    rows.append((T(2013, 11, 30, 1), "SE", "Gás", 7.0))
    return rows


def _pandas_tables(rows):
    df = pd.DataFrame(rows, columns=["Data", "Subsistema", "Tipo", "Geracao"])
    df["Tipo"] = df["Tipo"].replace(FUEL_CLASS)
    wide = df.pivot_table(index="Data", columns="Tipo", values="Geracao", aggfunc="sum")
    for tipo in list(wide.columns):
        part = df[df["Tipo"] == tipo].pivot_table(index="Data", columns="Subsistema", values="Geracao", aggfunc="sum")
        part.columns = [f"{tipo}_{c}" for c in part.columns]
        wide = wide.join(part, how="outer")
    daily_mean = wide.resample("D").mean()
    daily_mean.loc["2013-12-01"] = daily_mean.loc["2013-12-02"].values
    return {"daily_MWh": wide.resample("D").sum(), "monthly_MWh": wide.resample("ME").sum(),
            "daily_MWmed": daily_mean, "monthly_MWmed": wide.resample("ME").mean()}


def test_generation_tables_match_pandas(spark):
    rows = _generation_rows()
    df = spark.createDataFrame(rows, "ts timestamp_ntz, sub string, fuel string, value double")
    got = flows.generation_tables(df, patches=patches_df(spark))
    exp = _pandas_tables(rows)
    for name, ptab in exp.items():
        g = {(r.series, r.Data): r.value for r in got[name].collect()}
        for d, row in ptab.iterrows():
            for col in ptab.columns:
                v, e = g.get((col, d.date())), row[col]
                if pd.isna(e):
                    assert v is None, (name, col, d)
                else:
                    assert v is not None and abs(v - e) < 1e-9, (name, col, d, v, e)


def test_training_frame_and_ols_study_vs_numpy(spark):
    rng = np.random.default_rng(7)
    days = pd.date_range("2010-01-01", periods=120, freq="D")
    load = rng.normal(50, 5, 120)
    sst = rng.normal(0, 1, 120)
    gen = 3 * load + 10 * sst + rng.normal(0, 1, 120)
    targets = spark.createDataFrame([(d.date(), float(g), None) for d, g in zip(days, gen)],
                                    "Data date, Hidr double, Outras double")
    ld = spark.createDataFrame([(d.date(), float(x)) for d, x in zip(days, load)], "Data date, CARGA_N double")
    ss = spark.createDataFrame([(d.date(), float(x)) for d, x in zip(days, sst)], "Data date, `NIN 3.4_sst` double")
    frame, tcols, ecols = flows.training_frame(targets, ld, [ss], drop=("Outras",))
    assert tcols == ["Hidr"] and set(ecols) == {"CARGA_N", "NIN 3.4_sst", "year", "month", "day", "weekday",
                                                "dayofyear", "quarter"}
    assert frame.where(F.col("split") == "test").count() == int(np.ceil(0.3 * 120))
    met, pred, model = flows.ols_study(frame, tcols, ecols)
    pdf = frame.toPandas().sort_values("Data")
    tr, te = pdf[pdf.split == "train"], pdf[pdf.split == "test"]
    X, Xt = tr[ecols].to_numpy(float), te[ecols].to_numpy(float)
    Xc = X - X.mean(0)
    coef = np.linalg.lstsq(Xc, tr["Hidr"].to_numpy() - tr["Hidr"].mean(), rcond=None)[0]
    yhat = np.clip(tr["Hidr"].mean() + (Xt - X.mean(0)) @ coef, 0, None)
    m = pd.DataFrame({"a": te["Hidr"].to_numpy(), "p": yhat}, index=pd.to_datetime(te["Data"])).resample("ME").mean()
    r2 = 1 - ((m.a - m.p) ** 2).sum() / ((m.a - m.a.mean()) ** 2).sum()
    row = met.first()
    assert abs(row.r2 - r2) < 1e-6 and abs(row.mse - ((m.a - m.p) ** 2).mean()) < 1e-4
    n, p = len(te), len(ecols)
    assert abs(row.adj_r2 - (1 - (1 - r2) * (n - 1) / (n - p - 1))) < 1e-6 and row.n_daily == n


def test_rf_and_forecast_studies_run(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2015-01-01", periods=500, freq="D")
    rows = [(s, d.date(), float(100 + 10 * np.sin(i / 20) + rng.normal())) for s in ("H", "W") for i, d in enumerate(days)]
    daily = spark.createDataFrame(rows, "series string, Data date, value double")
    known = daily.where("series = 'H'").select("Data", (F.col("value") * 2).alias("load.x"), F.dayofyear("Data").alias("d"))
    fs = flows.forecast_study(daily, context=8, horizon=4, season=4, exog=known).collect()
    assert {(r.model, r.target) for r in fs} == {(m, t) for m in ("naive", "seasonal", "linear", "linear_exog")
                                                 for t in ("H", "W")}
    error = {(r.model, r.target): r.mse for r in fs}
    assert error["linear_exog", "H"] < 0.1 * error["linear", "H"]       # the channel is known in advance
    assert all(r.mse >= 0 for r in fs)
    wide = flows.to_wide(daily.withColumnRenamed("series", "series"), names=["H", "W"])
    frame = wide.withColumn("x", F.dayofyear("Data").cast("double")).withColumn(
        "split", F.when(F.col("Data") < F.lit("2016-01-01").cast("date"), "train").otherwise("test"))
    met, pred = flows.rf_study(frame, ["H"], ["x"], num_trees=5, max_depth=4)
    assert met.count() == 1 and pred.where(F.col("predicted") < 0).count() == 0


def test_daily_only_tables_equal_full_tables(spark):
    rows = _generation_rows()
    df = spark.createDataFrame(rows, "ts timestamp_ntz, sub string, fuel string, value double")
    full = flows.generation_tables(df, patches=patches_df(spark))
    daily = flows.generation_tables(df, patches=patches_df(spark), hourly=False)
    assert "hourly_MWmed" in full and "hourly_MWmed" not in daily
    for name in daily:
        assert sorted(map(tuple, full[name].collect())) == sorted(map(tuple, daily[name].collect()))
