"""Queries: incremental landing and refresh (SRC-9, PIP-1) through Structured
Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rnd
from ..session import ensure_checkpoint_dir, read_table
from ..sources import csv_files as CF
from ..streaming.landing import land_new_files
from ..streaming.refresh import refresh
from . import standins as S
from .registry import GEN_CTE, R, query


@query("landing_events", sql="SELECT event_id, ts, user_id, event_type, value, props FROM events")
def landing_events(spark, base):
    """Stream every ``events`` file of the folder into a landed Parquet table
    (run twice: the second run finds nothing new) and return what landed."""
    src = f"{base.rstrip('/')}/events*.parquet"
    schema = read_table(spark, base, "events").schema
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/enclima-landing/{uuid.uuid4().hex}"
    for _ in range(2):
        land_new_files(spark, src, schema, f"{root}/table", f"{root}/_checkpoint", fmt="parquet")
    return spark.read.parquet(f"{root}/table").drop("_file")


def deliver(spark, facts, root, step):
    """One file per year, named by it, in the step's folder."""
    parts = f"{root}/parts/{step}"
    facts.withColumn("year", F.year("ts")).repartition("year").write.partitionBy("year").parquet(parts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/in/{step}"))
    for f in CF.list_files(spark, f"{parts}/year=*/*.parquet"):
        year = f.split("/year=")[1].split("/")[0]
        fs.rename(path(f), path(f"{root}/in/{step}/generation_{year}.parquet"))


@query("incremental_refresh", sql=f"""WITH {GEN_CTE}
SELECT 'daily' AS table_name, sub AS series, CAST(ts AS DATE) AS Data, {R('SUM(value)')} AS total, COUNT(value) AS n
FROM gen GROUP BY ALL
UNION ALL SELECT 'monthly', sub, last_day(CAST(ts AS DATE)), {R('SUM(value)')}, COUNT(value) FROM gen GROUP BY ALL""")
def incremental_refresh(spark, base):
    """Two deliveries, the second with a late and a repeated file, equal a full
    rebuild."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/enclima-landing/{uuid.uuid4().hex}"
    facts = S.gen_fact(spark, base).select(F.col("ts").cast("date").alias("ts"), "sub", "value")
    year = F.year("ts")

    def run():
        return refresh(spark, f"{root}/in/*", "ts date, sub string, value double", f"{root}/tables", f"{root}/_checkpoint",
                       lambda d: d.withColumnRenamed("sub", "series"))

    deliver(spark, facts.where((year <= 1996) | ((year == 1998) & (F.dayofmonth("ts") < 20))), root, 0)
    run()
    deliver(spark, facts.where((year >= 1996)), root, 1)        # 1996 again, 1998 whole, the years behind it
    run()
    run()                                                       # nothing new
    out = None
    for name in ("daily", "monthly"):
        part = spark.read.parquet(f"{root}/tables/{name}").select(
            F.lit(name).alias("table_name"), "series", "Data", rnd("total").alias("total"), "n")
        out = part if out is None else out.unionByName(part)
    return out
