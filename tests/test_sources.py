"""File sources, sinks and the streaming landing (SRC-1..9, SNK-1/2, S12, S13)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from enclima.plans import flows
from enclima.sources import csv_files as CF
from enclima.sources import index_text as IT
from enclima.streaming.landing import land_new_files


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_index_text_layouts(spark, tmpdir_path):
    months = " ".join(f"{m / 10:.2f}" for m in range(1, 13))
    _write(f"{tmpdir_path}/idx/ONI.txt",
           "1950 1951\n"
           f"1950 {months}\n"
           "1951 0.10 -99.9 0.30 abc 0.50 0.60 0.70 0.80 0.90 1.00 1.10 1.20\n"
           "  -99.9\n"
           "free text line made of exactly thirteen words that is not a data row\n"
           "  ONI from CPC\n")
    _write(f"{tmpdir_path}/idx/MEI V2.txt", "1979 1979\n1979 " + " ".join(["0.5"] * 12) + "\n")
    _write(f"{tmpdir_path}/idx/AMO.txt", "1950 1950\n1950 " + " ".join(["-99.990"] * 11 + ["0.25"]) + "\n -99.990\n")
    lines = IT.read_index_lines(spark, f"{tmpdir_path}/idx/*.txt")
    long = IT.parse_wide_lines(lines)
    assert long.count() == 48                                   # 4 data lines x 12 months
    v = {(r["index"], r.Data): r.value for r in long.collect()}
    assert v[("ONI", dt.date(1951, 4, 1))] is None              # unparseable -> NULL (coerce)
    cl = {(r["index"], r.Data): r.value for r in IT.null_sentinels(long).collect()}
    assert cl[("ONI", dt.date(1951, 2, 1))] is None and cl[("AMO", dt.date(1950, 1, 1))] is None
    assert cl[("AMO", dt.date(1950, 12, 1))] == 0.25 and cl[("MEI V2", dt.date(1979, 3, 1))] == 0.5
    merged = {r.Data: r for r in IT.merge_indices(IT.null_sentinels(long), ["AMO", "ONI"]).collect()}
    assert merged["1951-01"]["AMO"] is None and merged["1951-01"]["ONI"] == 0.1


def test_semicolon_layout(spark, tmpdir_path):
    _write(f"{tmpdir_path}/semi/IASAS.txt", "data;valor\nxxx01Jan2000;1.5\nxxx01Feb2000;bad\n")
    df = IT.read_semicolon_files(spark, f"{tmpdir_path}/semi/*.txt")
    rows = {r.Data: r.value for r in df.collect()}
    assert rows == {dt.date(2000, 1, 1): 1.5, dt.date(2000, 2, 1): None}


def test_csv_layouts_by_name_and_missing_month(spark, tmpdir_path):
    d = f"{tmpdir_path}/ons"
    _write(f"{d}/GERACAO_USINA-2_2021.csv",
           "din_instante;id_subsistema;nom_tipocombustivel;val_geracao;extra\n"
           "2021-12-31 23:00:00;SE;Gás;10.5;x\n")
    _write(f"{d}/GERACAO_USINA-2_2022_01.csv",                  # other column order
           "val_geracao;nom_tipocombustivel;din_instante;id_subsistema\n"
           "7.25;Hidráulica;2022-01-01 00:00:00;N\n")
    _write(f"{d}/GERACAO_USINA-2_2022_03.csv",                  # February file missing
           "din_instante;id_subsistema;nom_tipocombustivel;val_geracao\n"
           "2022-03-01 01:00:00;S;Eólica;3.0\n")
    cols = ["din_instante", "id_subsistema", "nom_tipocombustivel", "val_geracao"]
    raw = CF.read_layouts(spark, f"{d}/GERACAO_USINA-2_*.csv", cols,
                          rename={"din_instante": "Data", "id_subsistema": "Subsistema",
                                  "nom_tipocombustivel": "Tipo", "val_geracao": "Geracao"})
    typed = CF.typed_measurements(CF.with_file_period(raw), "Data", "yyyy-MM-dd HH:mm:ss", ["Geracao"])
    got = {r.Subsistema: (r.Data, r.Tipo, r.Geracao, r.file_year, r.file_month) for r in typed.collect()}
    assert got["N"] == (dt.datetime(2022, 1, 1), "Hidráulica", 7.25, 2022, 1)
    assert got["SE"] == (dt.datetime(2021, 12, 31, 23), "Gás", 10.5, 2021, None)
    assert dict(typed.dtypes)["Data"] == "timestamp_ntz"


def test_strict_cast_raises_lenient_nulls(spark, tmpdir_path):
    _write(f"{tmpdir_path}/bad/CURVA_CARGA_2001.csv", "din_instante;id_subsistema;val_cargaenergiahomwmed\n"
                                                     "2001-01-01 00:00:00;N;oops\n")
    raw = CF.read_layouts(spark, f"{tmpdir_path}/bad/*.csv", ["din_instante", "val_cargaenergiahomwmed"])
    with pytest.raises(Exception):
        CF.typed_measurements(raw, "din_instante", "yyyy-MM-dd HH:mm:ss", ["val_cargaenergiahomwmed"]).collect()
    lenient = CF.typed_measurements(raw, "din_instante", "yyyy-MM-dd HH:mm:ss", ["val_cargaenergiahomwmed"], strict=False)
    assert lenient.first()["val_cargaenergiahomwmed"] is None


def test_sinks_time_order_and_partitions(spark, tmpdir_path):
    df = spark.createDataFrame([(dt.date(2000, 1, d), float(d)) for d in range(28, 0, -1)], "Data date, v double")
    CF.write_wide_csv(df.repartition(4), f"{tmpdir_path}/wide")
    back = spark.read.option("header", "true").csv(f"{tmpdir_path}/wide")
    parts = sorted(p for p in os.listdir(f"{tmpdir_path}/wide") if p.startswith("part-"))
    dates = []
    for p in parts:
        with open(f"{tmpdir_path}/wide/{p}", encoding="utf-8") as f:
            dates += [ln.split(",")[0] for ln in f.read().splitlines()[1:]]
    assert dates == sorted(dates) and len(dates) == 28 and back.columns[0] == "Data"
    long = df.withColumn("region", F.when(F.col("v") > 10, "A").otherwise("B")).withColumn("year", F.year("Data"))
    CF.write_partitioned(long, f"{tmpdir_path}/part", ["region", "year"])
    assert sorted(os.listdir(f"{tmpdir_path}/part/region=A")) == ["year=2000"]
    assert CF.read_curated(spark, f"{tmpdir_path}/part", ["v"]).count() == 28


def test_landing_picks_each_file_once(spark, tmpdir_path):
    src, out, ck = f"{tmpdir_path}/land", f"{tmpdir_path}/curated", f"{tmpdir_path}/ck"
    schema = "din_instante string, id_subsistema string, val double"
    opts = {"header": "true", "sep": ";"}
    _write(f"{src}/a.csv", "din_instante;id_subsistema;val\n2020-01-01 00:00:00;N;1\n2020-01-01 01:00:00;N;2\n")
    land_new_files(spark, src, schema, out, ck, options=opts)
    land_new_files(spark, src, schema, out, ck, options=opts)      # nothing new: no repeats
    assert spark.read.parquet(out).count() == 2
    _write(f"{src}/b.csv", "din_instante;id_subsistema;val\n2020-01-02 00:00:00;S;3\n")
    land_new_files(spark, src, schema, out, ck, options=opts)
    assert spark.read.parquet(out).count() == 3


def test_indices_flow(spark, tmpdir_path):
    _write(f"{tmpdir_path}/i2/PDO.txt",
           "2000 2000\n2000 " + " ".join(["1.00"] * 11 + ["-9.9"]) + "\n")
    t = flows.indices_table(IT.read_index_lines(spark, f"{tmpdir_path}/i2/*.txt"))
    rows = {r.Data: r.PDO for r in t.collect()}
    assert rows["2000-01"] == 1.0 and rows["2000-12"] is None


def test_grid_long_source(spark, tmpdir_path):
    from enclima.dims import regions_df
    from enclima.operators import regions
    from enclima.sources.grid import read_grid_long, variable_label
    rows = [(dt.date(2020, 1, 1), 0.0, 359.75, 1.0), (dt.date(2020, 1, 1), 0.0, 180.0, float("nan")),
            (dt.date(2020, 1, 1), 0.0, 200.0, 3.0), (dt.date(2020, 1, 1), 0.0, 170.0, 5.0)]
    spark.createDataFrame(rows, "date date, lat double, lon double, value double").write.parquet(f"{tmpdir_path}/g")
    g = read_grid_long(spark, f"{tmpdir_path}/g")
    out = {r.region: r.value for r in regions.region_stat(g, regions_df(spark), "mean", by="parent").collect()}
    assert out == {"NIN 4": 4.0, "NIN 3.4": 3.0}        # 180 -> -180 (NaN skipped), 359.75 in no box
    assert variable_label("sea_surface_temperature") == "sst" and variable_label("x") == "x"


def test_a_long_period_is_dealt_to_several_files(spark, tmpdir_path, monkeypatch):
    """No task sorts or writes a whole year; rows without a date and repeated rows are kept."""
    from enclima.plans import q_files
    base, root = os.path.join(tmpdir_path, "tables"), os.path.join(tmpdir_path, "csv")
    monkeypatch.setattr(q_files, "FILE_ROWS", 50, raising=False)
    day = F.when(F.col("id") % 100 == 0, F.lit("1997-02-03")).when(F.col("id") != 7, F.lit("1994-05-06")).cast("timestamp")
    spark.range(0, 2000, 1, 4).select(
        F.lit(1).alias("l_suppkey"), day.alias("l_shipdate"), (F.col("id") % 50).cast("double").alias("l_quantity"),
        F.col("id").cast("double").alias("l_extendedprice"), F.lit(0.0).alias("l_tax")).write.parquet(f"{base}/lineitem.parquet")
    for name, text in (("supplier", "1 s_suppkey, 1 s_nationkey"), ("nation", "1 n_nationkey, 1 n_regionkey"),
                       ("region", "1 r_regionkey, 'ASIA' r_name")):
        spark.sql(f"SELECT {text}").write.parquet(f"{base}/{name}.parquet")
    q_files.write_period_csv(spark, base, root)
    lines = {f: len(open(f.removeprefix("file:")).readlines()) - 1 for f in CF.list_files(spark, f"{root}/files/*/load_*.csv")}
    year = [n for f, n in lines.items() if f.endswith("/load_1994.csv")]
    assert sum(year) == 1979 and len(year) > 10 and max(year) < 600
    assert [n for f, n in lines.items() if f.endswith("/load_1997_02.csv")] == [20] and sum(lines.values()) == 2000
