"""Gridded fields (SRC-8 read shape).

The binary NetCDF decoder is not part of this library; gridded data arrive
either long, ``(date, lat, lon, value)`` in Parquet, or dense, one
``ARRAY<value>`` per date (see ``operators.regions.grid_from_arrays``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import GRID_VARIABLES
from ..functions.nulls import nan_to_null


def variable_label(name: str) -> str:
    """Long variable name -> short label used in ``{region}_{label}`` columns
    (``sea_surface_temperature -> sst``); unknown names pass through."""
    return GRID_VARIABLES.get(name, name)


def read_grid_long(spark: SparkSession, path: str, date: str = "date", lat: str = "lat", lon: str = "lon",
                   value: str = "value") -> DataFrame:
    """Long grid cells from Parquet as ``(Data, lat, lon, value)`` with NaN as
    NULL; only these four columns are read."""
    df = spark.read.parquet(path).select(date, lat, lon, value)
    return df.select(F.to_date(F.col(date)).alias("Data"), F.col(lat).cast("double").alias("lat"),
                     F.col(lon).cast("double").alias("lon"), nan_to_null(F.col(value).cast("double")).alias("value"))
