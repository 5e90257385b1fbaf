"""Scalar statistics expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    if isinstance(c, (int, float)):
        return F.lit(c)
    return F.col(c) if isinstance(c, str) else c


def adjusted_r2(r2, n, p) -> Column:
    """``1 - (1 - r2) * (n - 1) / (n - p - 1)``; NULL when ``n - p - 1 = 0``."""
    r2c, nc, pc = _c(r2), _c(n), _c(p)
    return F.lit(1.0) - (F.lit(1.0) - r2c) * F.try_divide(nc - 1, nc - pc - 1)


def relative_diff(row, col) -> Column:
    """``(row - col) / col`` (NULL when ``col`` is 0)."""
    r, c = _c(row), _c(col)
    return F.try_divide(r - c, c)
