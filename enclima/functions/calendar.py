"""Calendar labels and features with pandas' resample conventions.

* day   -> the date itself
* week  -> the Sunday that ends the ISO week (pandas ``'W'`` = ``'W-SUN'``)
* month -> last day of the month (pandas ``'ME'``)
* year  -> 31 December (pandas ``'YE'``)
* hour  -> timestamp truncated to the hour
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def week_end(ts) -> Column:
    """Sunday closing the ISO week (time-zone free: date + 6 - weekday)."""
    c = _c(ts)
    return F.date_add(F.to_date(c), F.lit(6) - F.weekday(c))


def hour_start(ts) -> Column:
    """Timestamp truncated to the hour, kept as TIMESTAMP_NTZ (``date_trunc``
    would return a session-time-zone timestamp)."""
    c = _c(ts)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))


def month_end(ts) -> Column:
    return F.last_day(F.to_date(_c(ts)))


def year_end(ts) -> Column:
    return F.make_date(F.year(_c(ts)), F.lit(12), F.lit(31))


def pandas_weekday(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(_c(ts))


def bin_label(ts, freq: str) -> Column:
    c = _c(ts)
    if freq == "hour":
        return hour_start(c)
    if freq == "day":
        return F.to_date(c)
    if freq == "week":
        return week_end(c)
    if freq == "month":
        return month_end(c)
    if freq == "year":
        return year_end(c)
    raise ValueError(f"unknown frequency {freq!r}")


CALENDAR_FEATURES = ("year", "month", "day", "weekday", "dayofyear", "quarter")


def add_calendar_features(df: DataFrame, ts: str, prefix: str = "") -> DataFrame:
    """Integer calendar fields of ``ts``: year, month, day of month, weekday
    (Monday = 0), day of year and quarter (the reference names this last one
    ``quadrimestre`` but it holds the quarter)."""
    c = F.col(ts)
    return df.withColumns({
        f"{prefix}year": F.year(c),
        f"{prefix}month": F.month(c),
        f"{prefix}day": F.dayofmonth(c),
        f"{prefix}weekday": pandas_weekday(c),
        f"{prefix}dayofyear": F.dayofyear(c),
        f"{prefix}quarter": F.quarter(c),
    })
