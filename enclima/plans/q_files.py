"""Queries: measurement CSV files in several header layouts (SRC-1..3, S12),
file periods, and round trips through the sinks (SRC-6/7, SNK-1/2, SRT-1)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rnd
from ..session import ensure_checkpoint_dir, materialize
from ..sources import csv_files as CF
from . import standins as S
from .registry import LOAD_CTE, R, query


def write_load_csv(spark, base, root):
    """Stand-in input: load rows as ``;`` CSV files, years up to 1998 with one
    column order, later years with another order plus an extra column."""
    ld = S.load_fact(spark, base).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("din_instante"), F.col("sub").alias("id_subsistema"),
        F.col("value").cast("string").alias("val_cargaenergiahomwmed"), F.year("ts").alias("_y"))
    early = ld.where(F.col("_y") <= 1998).select("din_instante", "id_subsistema", "val_cargaenergiahomwmed")
    late = ld.where(F.col("_y") > 1998).select("val_cargaenergiahomwmed", F.lit("x").alias("nom_extra"),
                                               "id_subsistema", "din_instante")
    for name, part in (("layout_a", early), ("layout_b", late)):
        part.write.mode("overwrite").option("sep", ";").option("header", "true").csv(f"{root}/{name}")


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/enclima-csv/{uuid.uuid4().hex}"


@query("csv_layouts_load", sql=f"""WITH {LOAD_CTE}
SELECT CAST(ts AS DATE) AS Data, sub AS Subsistema, {R('SUM(value)')} AS Carga, COUNT(*) AS n FROM ld GROUP BY ALL""")
def csv_layouts_load(spark, base):
    root = _folder(spark)
    write_load_csv(spark, base, root)
    raw = CF.read_layouts(spark, f"{root}/*/*.csv", ["din_instante", "id_subsistema", "val_cargaenergiahomwmed"],
                          rename={"din_instante": "Data", "id_subsistema": "Subsistema",
                                  "val_cargaenergiahomwmed": "Carga"})
    typed = CF.typed_measurements(raw, "Data", "yyyy-MM-dd HH:mm:ss", ["Carga"])
    return typed.groupBy(F.to_date("Data").alias("Data"), "Subsistema").agg(
        rnd(F.sum("Carga")).alias("Carga"), F.count("*").alias("n"))


# --- SRC-2, S13: yearly and monthly files, some months without a file -----------------
MONTHLY_FROM = 1996
#: Rows up to which a period is one file.
FILE_ROWS = 500_000


def write_period_csv(spark, base, root):
    """Stand-in input: one file per year before ``MONTHLY_FROM`` and one per
    month from then on, named ``load_{year}.csv`` / ``load_{year}_{mm}.csv``
    (as folders of one year or month each, renamed to the file pattern). A
    period of more than ``FILE_ROWS`` rows is dealt by a hash of its rows to
    several files of that name, so no task sorts a whole period."""
    ld = S.load_fact(spark, base).select(
        F.date_format("ts", "yyyy-MM-dd").alias("din_instante"), F.col("sub").alias("id_subsistema"),
        F.col("value").cast("string").alias("val_carga"),
        F.when(F.year("ts") < MONTHLY_FROM, F.date_format("ts", "yyyy"))
         .otherwise(F.date_format("ts", "yyyy_MM")).alias("period"),
        F.xxhash64("ts", "sub", "l_quantity", "l_extendedprice", "l_tax", F.spark_partition_id()).alias("_hash"))
    # one row per period: bounded by the calendar
    slices = materialize(ld.groupBy(F.col("period").alias("_of")).agg(
        F.ceil(F.count("*") / FILE_ROWS).alias("_slices")))
    tasks = slices.agg(F.sum("_slices")).first()[0] or 1
    dealt = (ld.join(F.broadcast(slices), F.col("period").eqNullSafe(F.col("_of")))
             .withColumn("_slice", F.pmod("_hash", "_slices")).repartition(int(tasks), "period", "_slice")
             .select("din_instante", "id_subsistema", "val_carga", "period"))
    (dealt.sortWithinPartitions("period").write.partitionBy("period").option("sep", ";")
       .option("header", "true").csv(f"{root}/parts"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/files"))
    for i, f in enumerate(CF.list_files(spark, f"{root}/parts/period=*/*.csv")):
        period = f.split("/period=")[1].split("/")[0]
        fs.mkdirs(path(f"{root}/files/{i}"))
        fs.rename(path(f), path(f"{root}/files/{i}/load_{period}.csv"))


@query("csv_file_period", sql=f"""WITH {LOAD_CTE}
SELECT CAST(year(ts) AS INTEGER) AS file_year, CAST(CASE WHEN year(ts) >= {MONTHLY_FROM} THEN month(ts) END AS INTEGER) AS file_month,
       sub AS Subsistema, {R('SUM(value)')} AS Carga, COUNT(*) AS n FROM ld GROUP BY ALL""")
def csv_file_period(spark, base):
    root = _folder(spark)
    write_period_csv(spark, base, root)
    raw = CF.read_layouts(spark, f"{root}/files/*/load_*.csv", ["din_instante", "id_subsistema", "val_carga"],
                          rename={"din_instante": "Data", "id_subsistema": "Subsistema", "val_carga": "Carga"})
    typed = CF.with_file_period(CF.typed_measurements(raw, "Data", "yyyy-MM-dd", ["Carga"]))
    return typed.groupBy("file_year", "file_month", "Subsistema").agg(
        rnd(F.sum("Carga")).alias("Carga"), F.count("*").alias("n"))


# --- SNK-1, SRC-6, SRT-1: wide CSV in time order ------------------------------------
SUMS = ("l_quantity", "l_extendedprice")
_DAY_SQL = f"""{LOAD_CTE}, w AS (SELECT CAST(ts AS DATE) AS Data, {', '.join(f'{R(f"SUM({c})", 2)} AS {c}' for c in SUMS)}
FROM ld GROUP BY 1)"""


@query("wide_csv_roundtrip", sql=f"""WITH {_DAY_SQL}
SELECT Data, {', '.join(SUMS)}, LAG(Data) OVER (ORDER BY Data) AS row_before FROM w""")
def wide_csv_roundtrip(spark, base):
    """Daily sums written as one wide CSV table in time order and read again;
    ``row_before`` is the date of the row before it in the files."""
    path = _folder(spark)
    d = S.load_fact(spark, base).groupBy(F.to_date("ts").alias("Data")).agg(*[rnd(F.sum(c), 2).alias(c) for c in SUMS])
    CF.write_wide_csv(d, path)
    raw = CF.read_layouts(spark, f"{path}/*.csv", ["Data", *SUMS], sep=",", position="_at")
    back = CF.typed_measurements(raw, "Data", "yyyy-MM-dd", SUMS)
    # one row per date, so the window holds a calendar
    in_files = Window.orderBy("_file", "_at")
    return back.select("Data", *SUMS, F.lag("Data").over(in_files).alias("row_before"))


# --- SNK-2, SRC-7: partitioned table, pruned columns --------------------------------
@query("partitioned_roundtrip", sql=f"""WITH {LOAD_CTE}
SELECT sub, CAST(year(ts) AS INTEGER) AS year, {R('SUM(l_tax)')} AS tax, COUNT(*) AS n FROM ld
WHERE year(ts) >= 1995 GROUP BY ALL""")
def partitioned_roundtrip(spark, base):
    """Load rows written as folders per subsystem and year; two folder columns
    and one measure of the years from 1995 on are read again."""
    path = _folder(spark)
    ld = S.load_fact(spark, base).withColumn("year", F.year("ts"))
    CF.write_partitioned(ld, path, ["sub", "year"])
    back = CF.read_curated(spark, path, ["sub", "year", "l_tax"]).where(F.col("year") >= 1995)
    return back.groupBy("sub", "year").agg(rnd(F.sum("l_tax")).alias("tax"), F.count("*").alias("n"))
