"""Measurement CSV files and table sinks (SRC-1..3, SRC-6/7, SNK-1/2, S12, S13).

Spark's CSV reader maps columns by *position* across all files of a scan, so
files whose headers list the same columns in another order would be read
wrongly (S12). The reader here lists the files (metadata only), reads the
first line of each one to learn its layout, scans every layout group with its
own header, selects the wanted columns *by name* and unions the groups by
name. The scans themselves are ordinary distributed CSV scans.

A glob over the directory tolerates missing monthly files (S13); year and
month come from the file name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import nan_to_null

from ..operators.reshape import union_by_name


# Texts that a CSV reader takes as missing.
MISSING_MARKS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                 "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a Hadoop glob (driver-side listing, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    stats = fs.globStatus(path)
    if stats is None:
        return []
    return sorted(s.getPath().toString() for s in stats if s.isFile())


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        return (line or "").lstrip("﻿")
    finally:
        stream.close()


def read_layouts(spark: SparkSession, pattern: str, columns: Sequence[str], sep: str = ";",
                 rename: Mapping[str, str] | None = None, position: str | None = None) -> DataFrame:
    """Read every file matching ``pattern`` keeping ``columns`` by name.

    Values stay strings (typing is the caller's choice: strict ``cast`` under
    ANSI or lenient ``try_cast``); ``_file`` holds the file name. ``position``
    names a column that orders the rows of a file as they stand in it."""
    from concurrent.futures import ThreadPoolExecutor
    files = list_files(spark, pattern)
    # one short read per file (its header line); metadata-sized work, done
    # concurrently from the driver instead of a full extra pass over the data
    with ThreadPoolExecutor(max_workers=16) as pool:
        heads = list(pool.map(lambda f: _first_line(spark, f), files))
    groups: dict[tuple, list[str]] = defaultdict(list)
    for f, line in zip(files, heads):
        groups[tuple(h.strip().strip('"') for h in line.split(sep))].append(f)
    parts = []
    for header, paths in groups.items():
        missing = [c for c in columns if c not in header]
        if missing:
            raise ValueError(f"files {paths[:2]}... lack columns {missing}")
        schema = ", ".join(f"`{h}` string" for h in header)
        df = (spark.read.option("sep", sep).option("header", "true").option("enforceSchema", "false")
                   .schema(schema).csv(paths))
        kept = [*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_name").alias("_file")]
        if position:        # splits of a file in order, then the rows of a split
            kept.append(F.struct(F.col("_metadata.file_block_start").alias("split"),
                                 F.monotonically_increasing_id().alias("row")).alias(position))
        parts.append(df.select(*kept))
    if not parts:
        raise FileNotFoundError(pattern)
    out = union_by_name(parts)
    return out.withColumnsRenamed(dict(rename)) if rename else out


def with_file_period(df: DataFrame, file_col: str = "_file") -> DataFrame:
    """``..._{year}.csv`` or ``..._{year}_{mm}.csv`` -> year, month (NULL for
    yearly files)."""
    pat = r"_(\d{4})(?:_(\d{2}))?\.[^.]+$"
    month = F.regexp_extract(F.col(file_col), pat, 2)
    return df.withColumns({
        "file_year": F.regexp_extract(F.col(file_col), pat, 1).cast("int"),
        "file_month": F.when(month != "", month.cast("int")),
    })


def typed_measurements(df: DataFrame, ts: str, ts_format: str, numeric: Sequence[str], strict: bool = True) -> DataFrame:
    """Parse the time column as naive local time and the numeric columns as
    double. The usual missing marks and NaN become NULL; other text is strict (ANSI ``cast`` raises on bad text, like ``errors='raise'``)
    or lenient (``try_cast`` gives NULL, like ``errors='coerce'``)."""
    out = df.withColumn(ts, F.to_timestamp_ntz(F.col(ts), F.lit(ts_format)) if "H" in ts_format
                        else F.to_date(F.col(ts), ts_format))
    def number(c):
        text = F.trim(F.col(f"`{c}`").cast("string"))
        text = F.when(~text.isin(MISSING_MARKS), text)
        return nan_to_null(text.cast("double") if strict else text.try_cast("double"))
    return out.withColumns({c: number(c) for c in numeric})


# --- sinks --------------------------------------------------------------------------
def write_wide_csv(df: DataFrame, path: str, ts: str = "Data", mode: str = "overwrite") -> None:
    """SNK-1: ``Data`` first, rows in time order, header, UTF-8. A global sort
    by range partitioning keeps part files in time order; no single-task
    coalesce."""
    cols = [ts] + [c for c in df.columns if c != ts]
    (df.select(*[F.col(f"`{c}`") for c in cols]).orderBy(ts)
       .write.mode(mode).option("header", "true").option("encoding", "UTF-8").csv(path))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet",
                      mode: str = "overwrite") -> None:
    """SNK-2 / curated layer: one folder per value of ``by`` (e.g. region,
    variable, year) instead of one small file per loop iteration.

    No shuffle by the partition key (a hot key would land in a single task):
    every task writes its own rows, sorted by the key so it keeps one file open
    at a time, and ``maxRecordsPerFile`` bounds file size."""
    w = (df.sortWithinPartitions(*by).write.mode(mode).option("maxRecordsPerFile", 5_000_000)
           .partitionBy(*by))
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def read_curated(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC-6/7: re-read a curated table, optionally only some columns (the
    projection reaches the Parquet scan)."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
