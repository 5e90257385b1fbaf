"""Climatology, anomalies, rolling and normalised indices (AGG-10, AGG-15,
WIN-1..5, JOI-6, GEO-4, DEC-1).

All windows here run on *resampled* series (one row per series and period),
so a window partition holds at most the number of periods in the calendar
(e.g. 300 months), never raw facts. Per-series statistics (std, min, max) are
window aggregates over the same series partition, so they share the shuffle
of the rolling / lag windows instead of recomputing them for a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import ENSO_PHASES


def _series_stats(df: DataFrame, keys: Sequence[str], aggs: dict) -> DataFrame:
    """Attach per-series statistics to every row. With keys: window
    aggregates over the series partition (the input is a resampled series, so
    the partition is calendar-sized, and upstream windows on the same
    partitioning are not recomputed as a join would). Without keys: one small
    aggregate whose single row is inlined as literals."""
    if keys:
        w = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    row = df.agg(*[agg.alias(name) for name, agg in aggs.items()]).first()
    return df.withColumns({name: F.lit(row[name] if row else None) for name in aggs})


def _w(keys, ts):
    return Window.partitionBy(*keys).orderBy(F.col(ts))


def climatology(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str = "clim") -> DataFrame:
    """Month-of-year mean over the years: (keys, month, clim)."""
    return (df.groupBy(*keys, F.month(ts).alias("month"))
              .agg(F.avg(F.col(value)).alias(out)))


def anomaly(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str = "anomaly") -> DataFrame:
    """``value - climatology of its calendar month`` (WIN-2), one window pass
    partitioned by (series, month)."""
    w = Window.partitionBy(*keys, F.month(ts))
    return df.withColumn(out, F.col(value) - F.avg(F.col(value)).over(w))


def rolling_mean(df: DataFrame, keys: Sequence[str], ts: str, value: str, window: int = 3,
                 out: str | None = None, bucket: Column | None = None) -> DataFrame:
    """``rolling(window, min_periods=1).mean()``: trailing rows, NULLs skipped.
    ``bucket`` windows a very long series inside overlapping time buckets."""
    if bucket is None:
        w = _w(keys, ts).rowsBetween(-(window - 1), 0)
        return df.withColumn(out or value, F.avg(F.col(value)).over(w))
    from .split import with_neighbours
    nb = with_neighbours(df, keys, ts, bucket, window - 1, 0)
    w = _w(list(keys) + ["_b"], ts).rowsBetween(-(window - 1), 0)
    return nb.withColumn(out or value, F.avg(F.col(value)).over(w)).where(F.col("_own")).drop("_b", "_own")


def std_normalize(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """``df.div(df.std())`` - divide by the sample std of the series, no
    centring (WIN-3). A series with a single row or zero spread gives NULL."""
    j = _series_stats(df, list(keys), {"_std": F.stddev_samp(F.col(value))})
    return j.withColumn(out or value, F.try_divide(F.col(value), F.col("_std"))).drop("_std")


def anomaly_index(df: DataFrame, keys: Sequence[str], ts: str, value: str, window: int = 3,
                  bucket: Column | None = None):
    """Full index (WIN-4): anomaly -> trailing mean -> divide by sample std.

    Returns ``(monthly, climatology, index)`` like the reference helper; the
    index frame has columns (keys, ts, index).
    """
    keys = list(keys)
    clim = climatology(df, keys, ts, value)
    an = anomaly(df, keys, ts, value, out="_an")
    rolled = rolling_mean(an, keys, ts, "_an", window, bucket=bucket)
    idx = std_normalize(rolled, keys, "_an").select(*keys, ts, F.col("_an").alias("index"))
    return df, clim, idx


def add_lags(df: DataFrame, keys: Sequence[str], ts: str, value: str, lags: Sequence[int],
             fmt: str = "{value}_lag{k}", bucket: Column | None = None) -> DataFrame:
    """``shift(k)`` per series (WIN-5): the value ``k`` rows earlier.
    ``bucket`` windows a very long series inside overlapping time buckets."""
    cols = lambda w: {fmt.format(value=value, k=k): F.lag(F.col(value), k).over(w) for k in lags}
    if bucket is None:
        return df.withColumns(cols(_w(keys, ts)))
    from .split import with_neighbours
    nb = with_neighbours(df, keys, ts, bucket, max(lags), 0)
    return nb.withColumns(cols(_w(list(keys) + ["_b"], ts))).where(F.col("_own")).drop("_b", "_own")


def phase_label(df: DataFrame, keys: Sequence[str], value: str, out: str = "phase",
                names: Sequence[str] = ENSO_PHASES) -> DataFrame:
    """Five-way ENSO phase of each value (GEO-4).

    Ticks per series are ``min, min/4, (min+max)/2, max/2, max`` (AGG-17); a
    value takes the name of its nearest tick, the colder one on ties.
    """
    j = _series_stats(df, list(keys), {"_lo": F.min(value), "_hi": F.max(value)})
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col(value)
    ticks = [lo, lo / 4, (lo + hi) / 2, hi / 2, hi]
    dist = [F.abs(v - t) for t in ticks]
    best = F.least(*dist)
    label = F.when(v.isNull(), F.lit(None))
    for d, name in zip(dist, names):
        label = label.when(d == best, F.lit(name))
    return j.withColumn(out, label).drop("_lo", "_hi")


def decompose(df: DataFrame, keys: Sequence[str], ts: str, value: str, period: int = 12) -> DataFrame:
    """Classical additive decomposition of a monthly series (DEC-1).

    trend    = centred 2 x ``period`` moving average (NULL within half a period
               of either end)
    seasonal = mean of (value - trend) per position in the cycle (month of
               year), re-centred so the ``period`` means sum to zero
    resid    = value - trend - seasonal

    This is the classical moving-average method, not LOESS/MSTL.
    """
    if period != 12:
        raise ValueError("the cycle position is the month of the year: only period 12 is supported")
    keys = list(keys)
    h = period // 2
    w = _w(keys, ts)
    full = w.rowsBetween(-h, h)
    v = F.col(value)
    trend = F.when(
        F.count(v).over(full) == 2 * h + 1,
        (F.sum(v).over(full) - F.lit(0.5) * (F.lag(v, h).over(w) + F.lead(v, h).over(w))) / F.lit(float(period)))
    t = df.withColumn("trend", trend).withColumn("_pos", F.month(ts))
    det = t.groupBy(*keys, "_pos").agg(F.avg(v - F.col("trend")).alias("_m"))
    seas = det.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy(*keys))).drop("_m")
    return (t.join(seas, [*keys, "_pos"], "left")
             .withColumn("resid", v - F.col("trend") - F.col("seasonal"))
             .drop("_pos"))
