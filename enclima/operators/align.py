"""Time alignment, date intersection, peak drill-down, model pairing
(JOI-2..5, JOI-7, JOI-9, SET-2, AGG-11, TOP-1, FLT-3).

All joins are equi-joins on the time key (or the source key for model
pairs); the planner picks sort-merge or broadcast from sizes (AQE re-plans on
measured sizes), nothing is forced here.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lit_time
from .clean import drop_incomplete


def align(frames: Sequence[DataFrame], on: str | Sequence[str], how: str = "inner",
          complete: bool = False) -> DataFrame:
    """Join frames on the time key.

    ``how='inner'`` + ``complete=True`` is ``pd.concat(axis=1).dropna()``
    (JOI-3); ``how='left'`` keeps the first frame's dates (JOI-4);
    ``how='full'`` is the outer alignment (JOI-2)."""
    keys = [on] if isinstance(on, str) else list(on)
    out = reduce(lambda a, b: a.join(b, keys, how), frames)
    return drop_incomplete(out) if complete else out


def common_dates(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Dates present in both tables (SET-2). Each side is reduced to its
    distinct dates first (partial aggregation collapses a hot date before any
    shuffle), so the set operation only sees calendar-sized inputs."""
    return a.select(on).distinct().intersect(b.select(on).distinct())


def restrict_to_common(a: DataFrame, b: DataFrame, on: str):
    """``a.loc[common], b.loc[common]`` (JOI-5) via semi joins."""
    ka, kb = a.select(on).distinct(), b.select(on).distinct()
    return a.join(kb, on, "left_semi"), b.join(ka, on, "left_semi")


def peak_instant(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Row of the maximum ``value``, the earliest on ties (``idxmax``). A
    distributed top-1 (each partition keeps its best row)."""
    return df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), F.col(ts).asc()).limit(1)


def rows_on_day_of(df: DataFrame, ts: str, instants: DataFrame, instant_ts: str) -> DataFrame:
    """All rows of ``df`` on the calendar day of the instant(s) (FLT-3 + JOI-9);
    the join strategy is the planner's choice."""
    days = instants.select(F.to_date(F.col(instant_ts)).alias("_day")).distinct()
    return df.join(days, F.to_date(F.col(ts)) == F.col("_day"), "left_semi")


def rows_on_instant_day(df: DataFrame, ts: str, instant: DataFrame, instant_ts: str) -> DataFrame:
    """As ``rows_on_day_of`` for one instant (the first row of ``instant``): the
    day is read first and becomes a literal range on ``ts``, which reaches the
    scan of ``df``. Without an instant there are no rows."""
    row = instant.select(F.to_date(F.col(instant_ts)).alias("_day")).first()
    if row is None or row[0] is None:
        return df.where(F.lit(False))
    lo = dt.datetime(row[0].year, row[0].month, row[0].day)
    return df.where((F.col(ts) >= lit_time(lo)) & (F.col(ts) < lit_time(lo + dt.timedelta(days=1))))


def model_delta(metrics: DataFrame, models: Sequence[str], by: str = "source", model: str = "model",
                value: str = "mse") -> DataFrame:
    """Relative change of ``value`` between every ordered pair of the listed
    models per source, ``(a - b) / b`` in percent (JOI-7 + MTH-3 + EVL-5).

    The metrics table (one row per model and source) is pivoted to one row per
    source with one column per model, then each pair is a projection - no
    self-join and no pair generation inside groups."""
    from .reshape import pivot_masks
    models = list(models)
    wide = pivot_masks(metrics, [by], {m: F.col(model) == F.lit(m) for m in models}, value, how="first")
    pairs = [(a, b) for a in models for b in models if a != b]
    cols = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                     (F.lit(100.0) * F.try_divide(F.col(f"`{a}`") - F.col(f"`{b}`"), F.col(f"`{b}`")))
                     .alias("delta_pct")) for a, b in pairs]
    return (wide.select(by, F.explode(F.array(*cols)).alias("_p"))
                .select(by, "_p.model_a", "_p.model_b", "_p.delta_pct"))
