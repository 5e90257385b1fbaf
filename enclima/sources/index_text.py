"""Monthly climate-index text files (SRC-4, SRC-5, RSH-1, NUL-1, JOI-1).

Layout A (blank separated): a header ``first_year last_year``, then one line per
year ``year v1 ... v12``, then a sentinel line and free text. Only lines with
exactly 13 tokens are data; the rest drop out by that rule alone.

Layout B (``;`` separated): one header line, then ``date;value`` where the date
is three leading characters followed by ``ddMMMyyyy``.

Both parse into the long model ``(index, Data DATE = first of month, value)``;
unparseable numbers become NULL (``errors='coerce'``). Merging indices is a
union + one pivot on the month (one shuffle) instead of N-1 outer joins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import nan_to_null

from ..dims import sentinels_df
from ..operators.reshape import pivot_masks


def read_index_lines(spark: SparkSession, path: str) -> DataFrame:
    """(index, line) for every line of every file under ``path`` (a glob); the
    index name is the file name without its extension."""
    raw = spark.read.text(path).select(F.col("value").alias("line"),
                                       F.url_decode(F.col("_metadata.file_name")).alias("_f"))
    return raw.select(F.regexp_extract("_f", r"^(.*?)(\.[^.]*)?$", 1).alias("index"), "line")


def parse_wide_lines(lines: DataFrame, index: str = "index", line: str = "line") -> DataFrame:
    """Layout A -> (index, Data, value)."""
    tok = F.split(F.trim(F.col(line)), r"\s+")
    rows = (lines.select(F.col(index).alias("index"), tok.alias("_t"))
                 .where(F.size("_t") == 13)
                 .select("index", F.expr("try_cast(_t[0] AS INT)").alias("_y"),
                         F.posexplode(F.slice("_t", 2, 12)).alias("_p", "_v"))
                 .where(F.col("_y").isNotNull()))
    return rows.select("index", F.make_date("_y", F.col("_p") + 1, F.lit(1)).alias("Data"),
                       nan_to_null(F.expr("try_cast(_v AS DOUBLE)")).alias("value"))


def parse_semicolon_rows(rows: DataFrame, index: str, date: str, value: str) -> DataFrame:
    """Layout B rows (already split on ``;``, header removed) -> (index, Data, value)."""
    # drop the three leading characters, keep the whole rest of the text
    d = F.to_date(F.expr(f"substr(trim(`{date}`), 4)"), "ddMMMyyyy")
    return rows.select(F.col(index).alias("index"), F.trunc(d, "MM").alias("Data"),
                       nan_to_null(F.expr(f"try_cast(trim(`{value}`) AS DOUBLE)")).alias("value"))


def read_semicolon_files(spark: SparkSession, path: str) -> DataFrame:
    """Read layout B files (header skipped per file) -> (index, Data, value)."""
    raw = (spark.read.option("sep", ";").option("header", "true").csv(path)
                .select("*", F.url_decode(F.col("_metadata.file_name")).alias("_f")))
    c_date, c_val = raw.columns[0], raw.columns[1]
    named = raw.withColumn("_index", F.regexp_extract("_f", r"^(.*?)(\.[^.]*)?$", 1))
    return parse_semicolon_rows(named, "_index", c_date, c_val)


def null_sentinels(df: DataFrame, sentinels: DataFrame | None = None, index: str = "index",
                   value: str = "value") -> DataFrame:
    """Per-index sentinel -> NULL by exact double equality (NUL-1). The
    sentinel table is a literal dimension (32 rows); the planner knows its size."""
    s = sentinels if sentinels is not None else sentinels_df(df.sparkSession)
    s = s.withColumnRenamed("index", "_sidx")
    j = df.join(s, F.col(index) == F.col("_sidx"), "left")
    return j.withColumn(value, F.when(F.col("invalid").isNull() | (F.col(value) != F.col("invalid")),
                                      F.col(value))).drop("_sidx", "invalid")


def merge_indices(df: DataFrame, indices: Iterable[str], month_label: bool = True) -> DataFrame:
    """Wide monthly table: one column per index, ``Data`` as ``yyyy-MM`` text
    (full outer alignment on the month)."""
    d = df.withColumn("Data", F.date_format("Data", "yyyy-MM") if month_label else F.col("Data"))
    masks = {i: F.col("index") == F.lit(i) for i in indices}
    return pivot_masks(d, ["Data"], masks, "value", how="first")
