"""Missing-value rules (pandas NaN semantics re-expressed on SQL NULL).

S1: NaN is converted to NULL at ingest so every aggregate skips it.
S2: a sum over only missing values is 0, not NULL.
S9: clamping negatives keeps missing values missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    x = _c(c)
    return F.when(~F.isnan(x), x)


def sum_or_zero(c) -> Column:
    """Aggregate: pandas ``sum`` (missing skipped, all-missing = 0)."""
    return F.coalesce(F.sum(_c(c)), F.lit(0.0))


def clamp_negative(c) -> Column:
    """``y[y < 0] = 0`` - NULL stays NULL (``greatest`` would turn it into 0)."""
    x = _c(c)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)
