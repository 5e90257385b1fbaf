"""Column-level helpers built only from native Spark SQL functions.

Everything here returns a ``Column`` (or a tiny literal DataFrame) so it stays
inside whole-stage codegen; nothing runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .calendar import (add_calendar_features, bin_label, month_end, week_end,
                       year_end, pandas_weekday)
from .nulls import clamp_negative, nan_to_null, sum_or_zero
from .stats import adjusted_r2, relative_diff

__all__ = [
    "add_calendar_features", "bin_label", "month_end", "week_end", "year_end", "pandas_weekday",
    "clamp_negative", "nan_to_null", "sum_or_zero", "adjusted_r2", "relative_diff",
    "lon_wrap", "rnd", "col_of", "lit_time",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lon_wrap(lon) -> Column:
    """Longitude in 0..360 (or any range) to -180..180 with Python-modulo rules.

    ``(x + 180) % 360 - 180`` where ``%`` keeps the divisor's sign, so 180 maps
    to -180 and 359.75 to -0.25.
    """
    return F.pmod(col_of(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def lit_time(v) -> Column:
    """Literal for a value read back from a time column: dates stay DATE,
    naive datetimes become TIMESTAMP_NTZ from their text (a plain ``lit`` of a
    datetime would be read in the session time zone)."""
    import datetime as _dt
    if isinstance(v, _dt.datetime):
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(v)


def rnd(c, digits: int = 4) -> Column:
    """Round for order-insensitive comparison of float sums (both sides)."""
    return F.round(col_of(c), digits)
