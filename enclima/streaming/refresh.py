"""Incremental refresh of curated tables from landing files (SRC-9, PIP-1, PIP-2).

A Structured Streaming file source hands over the files that arrived since the
last run; every micro-batch recomputes only what its files touch:

* ``facts/month=yyyyMM/file=NAME``: the rows of the file. A file that comes
  again under its name (a later, more complete download of its period)
  replaces its rows; of two in one batch the later one counts.
* ``daily/month=yyyyMM``: (series, Data, total, n) of the months that the
  batch touches, from all facts of these months.
* ``monthly/month=yyyyMM``: the same per month, from the daily rows.

All three are written by dynamic partition overwrite, so a batch that is
replayed after a failure gives the same tables, and a late file changes its own
months only. Means are ``total / n``; rows without a value count for nothing
but keep their day (total 0, n 0).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str, *by: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def apply_batch(rows: DataFrame, target: str) -> list[int]:
    """One batch: ``rows`` (series, ts, value, file, modified). Returns the
    months that were written."""
    spark = rows.sparkSession
    newest = rows.groupBy("file").agg(F.max("modified").alias("modified"))
    rows = (rows.join(newest, ["file", "modified"])
            .select("series", "ts", F.col("value").cast("double").alias("value"),
                    (F.year("ts") * 100 + F.month("ts")).alias("month"), "file"))
    months = sorted(r["month"] for r in rows.where("month IS NOT NULL").select("month").distinct().collect())   # a calendar
    if not months:
        return []
    _write(rows.where("month IS NOT NULL"), f"{target}/facts", "month", "file")
    facts = spark.read.parquet(f"{target}/facts").where(F.col("month").isin(months))
    totals = [F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("value").alias("n")]
    _write(facts.groupBy("series", F.to_date("ts").alias("Data"), "month").agg(*totals), f"{target}/daily", "month")
    daily = spark.read.parquet(f"{target}/daily").where(F.col("month").isin(months))
    _write(daily.groupBy("series", F.last_day("Data").alias("Data"), "month").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")), f"{target}/monthly", "month")
    return months


def refresh(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str,
            transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
            options: Mapping[str, str] | None = None) -> list[tuple[int, list[int]]]:
    """Process the files of ``source`` (a folder or pattern) not seen before;
    ``transform`` adds or renames columns to (series, ts, value) and keeps
    ``_file`` and ``_modified``. Returns (batch, months written) of every
    micro-batch of this run."""
    reader = spark.readStream.format(fmt).schema(schema).options(**(options or {}))
    raw = reader.load(source).select("*", F.col("_metadata.file_name").alias("_file"),
                                     F.col("_metadata.file_modification_time").alias("_modified"))
    done = []

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch).select("series", "ts", "value", F.col("_file").alias("file"), F.col("_modified").alias("modified"))
        done.append((batch_id, apply_batch(rows, target)))

    query = (raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return done
