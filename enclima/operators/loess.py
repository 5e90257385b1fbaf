"""Seasonal-trend decomposition by locally weighted regression (DEC-1).

``loess`` fits a line around every position with tricube weights on the
nearest ``span`` positions. It is a weighted sum over neighbours: every value
is sent to the positions whose neighbourhood holds it, five sums per position
are aggregated, and the line at the position is a closed form of them. Long
series need no window and no task that holds a whole series there.

``decompose_loess`` runs the inner loop (smoothed cycle sub-series, low-pass
filter, trend) and, if asked for, the robust outer loop, for one or several
periods: with several, each period's seasonal part is fitted again on the
series without the others. Only the moving averages of the low-pass filter are
windows, over one resampled series.

Missing values have no weight; trend and seasonal parts are still given there,
the residual is NULL. Values at both ends are given.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize_at


def _odd(n: float) -> int:
    n = int(math.ceil(n))
    return n if n % 2 else n + 1


def loess(points: DataFrame, keys: Sequence[str], x: str, y: Column, span: int, last: Column,
          extend: int = 0, weight: Column | None = None, out: str = "fit") -> DataFrame:
    """(keys, x, fit): local line at every position ``-extend .. last + extend``
    of a series whose positions are ``0 .. last`` (``last`` is constant per
    series). ``span`` is odd; fewer positions than that are all neighbours."""
    half, keys = (span - 1) // 2, list(keys)
    reach = span + extend
    src = points.select(*[F.col(f"`{k}`") for k in keys], F.col(x).cast("long").alias("_j"), y.cast("double").alias("_y"),
                        last.cast("long").alias("_last"), (F.lit(1.0) if weight is None else weight).alias("_u"))
    near = src.where(F.col("_y").isNotNull()).withColumn("_x", F.explode(F.sequence(F.col("_j") - reach, F.col("_j") + reach))).where(
        (F.col("_x") >= -extend) & (F.col("_x") <= F.col("_last") + extend))
    few = F.col("_last") + 1 <= span
    left = F.when(few, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("_x") - half, F.col("_last") - span + 1)))
    right = F.when(few, F.col("_last")).otherwise(F.col("_left") + span - 1)
    near = near.withColumn("_left", left).withColumn("_right", right).where("_j >= _left AND _j <= _right")
    wide = (F.greatest(F.col("_x") - F.col("_left"), F.col("_right") - F.col("_x"))
            + F.floor(F.greatest(F.lit(span) - F.col("_last") - 1, F.lit(0)) / 2)).cast("double")
    gap, d = F.abs(F.col("_j") - F.col("_x")).cast("double"), (F.col("_j") - F.col("_x")).cast("double")
    w = F.col("_u") * F.when(gap <= 0.001 * F.col("_h"), F.lit(1.0)).when(
        gap <= 0.999 * F.col("_h"), F.pow(1 - F.pow(gap / F.col("_h"), F.lit(3.0)), F.lit(3.0))).otherwise(F.lit(0.0))
    sums = (near.withColumn("_h", wide).withColumn("_w", w).withColumn("_d", d)
            .groupBy(*keys, "_x", "_last").agg(
                F.sum("_w").alias("s0"), F.sum(F.col("_w") * F.col("_d")).alias("s1"),
                F.sum(F.col("_w") * F.col("_d") * F.col("_d")).alias("s2"), F.sum(F.col("_w") * F.col("_y")).alias("t0"),
                F.sum(F.col("_w") * F.col("_d") * F.col("_y")).alias("t1")))
    mean, spread = F.col("s1") / F.col("s0"), F.col("s2") / F.col("s0") - F.pow(F.col("s1") / F.col("s0"), F.lit(2.0))
    line = F.when(F.col("c") > F.pow(0.001 * F.col("_last"), F.lit(2.0)),
                  -F.col("a") / F.col("c") * (F.col("t1") - F.col("a") * F.col("t0"))).otherwise(F.lit(0.0))
    return (sums.where("s0 > 0").withColumn("a", mean).withColumn("c", spread)
            .select(*[F.col(f"`{k}`") for k in keys], F.col("_x").alias(x), ((F.col("t0") + line) / F.col("s0")).alias(out)))


def _inner(state: DataFrame, keys: list[str], period: int, seasonal: int, trend: int, low_pass: int) -> DataFrame:
    """One pass of the inner loop: new ``seasonal`` and ``trend``."""
    n = F.col("_n")
    sub = state.withColumn("_phase", F.col("pos") % period).withColumn("_cycle", F.floor(F.col("pos") / period))
    cycle = loess(sub, [*keys, "_phase", "_n"], "_cycle", F.col("y") - F.col("trend"), seasonal,
                  F.floor((n - 1 - F.col("_phase")) / period), extend=1, weight=F.col("rw"), out="c")
    cycle = cycle.select(*keys, "_n", (F.col("_cycle") * period + F.col("_phase")).alias("pos"), "c")
    w = Window.partitionBy(*keys).orderBy("pos")
    ma = (cycle.withColumn("m", F.avg("c").over(w.rowsBetween(0, period - 1)))
          .withColumn("m", F.avg("m").over(w.rowsBetween(0, period - 1))).withColumn("m", F.avg("m").over(w.rowsBetween(0, 2)))
          .where(F.col("pos") + period < n).select(*keys, "_n", (F.col("pos") + period).alias("pos"), "m"))
    low = loess(ma, [*keys, "_n"], "pos", F.col("m"), low_pass, n - 1, out="low").drop("_n")
    parts = (state.drop("seasonal", "trend").join(cycle.drop("_n"), [*keys, "pos"], "left").join(low, [*keys, "pos"], "left")
             .withColumn("seasonal", F.col("c") - F.col("low")).drop("c", "low"))
    parts, path = materialize_at(parts)
    line = loess(parts, [*keys, "_n"], "pos", F.col("y") - F.col("seasonal"), trend, n - 1, weight=F.col("rw"),
                 out="trend").drop("_n")
    out, out_path = materialize_at(parts.join(line, [*keys, "pos"], "left"))
    discard(state.sparkSession, path)
    return out, out_path


def decompose_loess(df: DataFrame, keys: Sequence[str], ts: str, value: str, periods: Sequence[int] = (12,),
                    windows: Sequence[int] | None = None, inner: int = 5, outer: int = 0, iterate: int = 2) -> DataFrame:
    """``df`` with trend, seasonal (the sum of all periods' parts),
    ``seasonal_{period}`` per period, and resid.

    ``df`` holds one row per series and time stamp without gaps. ``windows``:
    odd spans of the cycle sub-series (by default 11, 15, ... in the order of
    the periods); ``outer`` robust loops; ``iterate`` rounds over the periods."""
    keys, periods = list(keys), sorted(periods)
    windows = [7 + 4 * (i + 1) for i in range(len(periods))] if windows is None else list(windows)
    spark = df.sparkSession
    w = Window.partitionBy(*keys)
    place = (df.withColumn("pos", F.row_number().over(w.orderBy(ts)).cast("long") - 1)
             .withColumn("_n", F.count(F.lit(1)).over(w)))
    zero = {f"seasonal_{p}": F.lit(0.0) for p in periods}
    cur, path = materialize_at(place.withColumns({**zero, "trend": F.lit(0.0)}))
    for _ in range(iterate if len(periods) > 1 else 1):
        for p, span in zip(periods, windows):
            others = F.col(f"`{value}`").cast("double")
            for q in periods:
                if q != p:
                    others = others - F.col(f"seasonal_{q}")
            state = cur.select(*keys, "pos", "_n", others.alias("y"), F.lit(0.0).alias("trend"), F.lit(0.0).alias("seasonal"),
                               F.lit(1.0).alias("rw"))
            at = None
            for k in range(outer + 1):
                for _ in range(inner):
                    state, new = _inner(state, keys, p, span, _odd(1.5 * p / (1 - 1.5 / span)), _odd(p + 1))
                    if at:
                        discard(spark, at)
                    at = new
                if k < outer:
                    r = F.abs(F.col("y") - F.col("seasonal") - F.col("trend"))
                    # six medians of one resampled series
                    h = 6 * F.median(r).over(Window.partitionBy(*keys))
                    state = state.withColumn("_r", r).withColumn("_h", h).withColumn("rw", F.when(
                        F.col("_r") <= 0.001 * F.col("_h"), F.lit(1.0)).when(F.col("_r") <= 0.999 * F.col("_h"), F.pow(
                            1 - F.pow(F.col("_r") / F.col("_h"), F.lit(2.0)), F.lit(2.0))).otherwise(F.lit(0.0))).drop("_r", "_h")
            fit = state.select(*keys, "pos", F.col("seasonal").alias(f"seasonal_{p}"), "trend")
            nxt, new = materialize_at(cur.drop(f"seasonal_{p}", "trend").join(fit, [*keys, "pos"]))
            discard(spark, path, at)
            cur, path = nxt, new
    total = sum((F.col(f"seasonal_{p}") for p in periods[1:]), F.col(f"seasonal_{periods[0]}"))
    return (cur.withColumn("seasonal", total).withColumn("resid", F.col(f"`{value}`") - F.col("seasonal") - F.col("trend"))
            .drop("pos", "_n"))
