"""Chronological splits, folds and context/horizon windows (WIN-6..10).

Row positions are computed on the table of *distinct time stamps* only (one
row per date: thousands to a few hundred thousand rows, bounded by the
calendar, not by the data volume). One job returns the stamp count and the
handful of cut-off dates; the facts are then split with range predicates on
the time column, so no global sort or window ever runs over the facts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lit_time


def date_positions(df: DataFrame, ts: str) -> DataFrame:
    """(ts, pos, n): 1-based rank of each distinct time stamp and their count.

    The distinct stamps are reduced with partial aggregation across the
    cluster; only that calendar-sized table is ordered in one partition."""
    d = df.select(ts).distinct()
    return d.select(ts, F.row_number().over(Window.orderBy(F.col(ts))).alias("pos"),
                    F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def cut_dates(df: DataFrame, ts: str, wanted: dict) -> tuple[int, dict]:
    """One job: the number of time stamps ``n`` and, for every name in
    ``wanted``, the time stamp at the 1-based position ``wanted[name](n)``
    (a Column expression of ``n``; Spark's double arithmetic equals Python's,
    so ``floor(n * 0.7)`` is ``int(n * 0.7)``). Missing positions give None."""
    pos = date_positions(df, ts)
    flags = {k: F.col("pos") == f(F.col("n")) for k, f in wanted.items()}
    any_flag = F.col("pos") == 1
    for fl in flags.values():
        any_flag = any_flag | fl
    rows = pos.select(ts, "n", *[fl.alias(f"_w_{k}") for k, fl in flags.items()]).where(any_flag).collect()
    n = int(rows[0]["n"]) if rows else 0
    return n, {k: next((r[ts] for r in rows if r[f"_w_{k}"]), None) for k in wanted}


def _between(ts: str, lo, hi) -> Column:
    c = F.lit(True)
    if lo is not None:
        c = c & (F.col(ts) >= lit_time(lo))
    if hi is not None:
        c = c & (F.col(ts) <= lit_time(hi))
    return c


def train_test_split(df: DataFrame, ts: str, test_size: float = 0.3, label: str = "split") -> DataFrame:
    """``train_test_split(shuffle=False)``: the last ``ceil(test_size * n)``
    time stamps are test, the rest train (WIN-6)."""
    _, at = cut_dates(df, ts, {"cut": lambda n: n - F.ceil(F.lit(float(test_size)) * n)})
    cut = at["cut"]
    if cut is None:
        return df.withColumn(label, F.lit("test"))
    return df.withColumn(label, F.when(F.col(ts) <= lit_time(cut), "train").otherwise("test"))


def fraction_splits(df: DataFrame, ts: str, config: dict[str, tuple[float, float]] | None = None,
                    context: int = 0, label: str = "split") -> DataFrame:
    """Train / valid / test by relative fractions of the time stamps (WIN-7).

    Each split covers rows ``[int(n * start) - offset, int(n * end))`` (0-based),
    with ``offset = context`` for every split but the first, so valid and test
    start ``context`` rows early and overlap the previous split. A row in an
    overlap appears once per split it belongs to."""
    config = config or {"train": (0.0, 0.7), "valid": (0.7, 0.8), "test": (0.8, 1.0)}
    wanted = {}
    for i, (name, (s, e)) in enumerate(config.items()):
        off = context if i > 0 else 0
        wanted[f"{name}_lo"] = lambda n, s=s, off=off: F.floor(n * F.lit(float(s))) - off + 1
        wanted[f"{name}_hi"] = lambda n, e=e: F.floor(n * F.lit(float(e)))
    n, at = cut_dates(df, ts, wanted)
    parts = []
    for i, (name, (s, e)) in enumerate(config.items()):
        start = int(n * s) - (context if i > 0 else 0)
        if start < 0:
            raise ValueError(f"split {name!r} would start before the first row")
        if start + 1 > int(n * e):
            continue
        parts.append(df.where(_between(ts, at[f"{name}_lo"], at[f"{name}_hi"])).withColumn(label, F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def time_series_folds(df: DataFrame, ts: str, n_splits: int = 5, fold: str = "fold",
                      role: str = "role") -> DataFrame:
    """Expanding-window folds (``TimeSeriesSplit``): ``test_size = n // (k+1)``;
    fold i tests the i-th block of the last ``k`` blocks and trains on every
    earlier row. Output: one row per (row, fold) it takes part in (WIN-8)."""
    k = n_splits

    def size(n):
        return F.floor(n / F.lit(k + 1))

    wanted = {}
    for i in range(k):
        # 0-based start s = n - (k - i) * size -> 1-based positions s + 1 and s + size
        wanted[f"lo{i}"] = lambda n, i=i: n - (k - i) * size(n) + 1
        wanted[f"hi{i}"] = lambda n, i=i: n - (k - i) * size(n) + size(n)
    n, at = cut_dates(df, ts, wanted)
    if n // (k + 1) < 1:
        raise ValueError("too few rows for the requested folds")
    entries = []
    for i in range(k):
        test_lo, test_hi = at[f"lo{i}"], at[f"hi{i}"]
        entries.append(F.when(F.col(ts) < lit_time(test_lo), F.struct(F.lit(i).alias(fold), F.lit("train").alias(role)))
                        .when(F.col(ts) <= lit_time(test_hi), F.struct(F.lit(i).alias(fold), F.lit("test").alias(role))))
    e = df.withColumn("_f", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())))
    return e.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"_f.{fold}").alias(fold),
                    F.col(f"_f.{role}").alias(role))


def with_neighbours(df: DataFrame, keys: Sequence[str], ts: str, bucket: Column, before: int,
                    after: int) -> DataFrame:
    """Split a long series into time buckets for windowing.

    Every row is tagged with its bucket ``_b`` (a value that grows with time,
    e.g. ``year(ts)``) and ``_own = true``; the ``before`` rows that precede a
    bucket and the ``after`` rows that follow it are copied into it with
    ``_own = false``, from as many buckets as they span. A row window of at
    most ``before`` preceding and ``after`` following rows computed per (keys,
    bucket) then equals the one over the whole series for every own row, for
    any bucket sizes and gaps.

    Only a bucket's rows are ranked in one task; a row's place in the series is
    its rank plus the row counts of the earlier buckets (one small row per
    bucket)."""
    keys = list(keys)
    b = df.withColumn("_b", bucket.cast("long"))
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    reach = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b"))
    spans = (sizes.withColumn("_end", reach)
             .groupBy(*keys).agg(F.collect_list(F.struct("_b", (F.col("_end") - F.col("_n")).alias("_start"), "_end"))
                                 .alias("_spans")).select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)],
                                                          "_spans"))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(F.col(ts)))
    placed = b.withColumn("_r", rank).join(spans, match).drop(*[f"_k{i}" for i in range(len(keys))])
    mine = F.element_at(F.filter("_spans", lambda s: s["_b"].eqNullSafe(F.col("_b"))), 1)
    placed = placed.withColumn("_at", mine["_start"] + F.col("_r"))
    needed = F.filter("_spans", lambda s: s["_b"].eqNullSafe(F.col("_b"))
                      | ((F.col("_at") <= s["_start"]) & (F.col("_at") > s["_start"] - before))
                      | ((F.col("_at") > s["_end"]) & (F.col("_at") <= s["_end"] + after)))
    copies = placed.withColumn("_to", F.explode(F.transform(needed, lambda s: s["_b"])))
    return (copies.withColumn("_own", F.col("_to").eqNullSafe(F.col("_b"))).withColumn("_b", F.col("_to"))
            .drop("_r", "_spans", "_at", "_to"))


def context_windows(df: DataFrame, keys: Sequence[str], ts: str, value: str, context: int, horizon: int,
                    full_only: bool = True, exog: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """One row per origin with the ``context`` observations up to it and the
    ``horizon`` observations after it, as ``ARRAY<STRUCT<ts, value>>`` (NULL
    values keep their slot). Only complete windows by default (WIN-9).

    ``exog`` columns (known in advance, e.g. load or calendar) add an
    ``exog_horizon`` array: their values over the horizon, column by column.

    The partition is a resampled series (bounded by its calendar length); for
    a very long series pass ``bucket`` (e.g. ``F.year(ts)``) to window inside
    time buckets with overlapping edges (``with_neighbours``)."""
    keys = list(keys)
    src = df
    if bucket is not None:
        src = with_neighbours(df, keys, ts, bucket, context - 1, horizon)
        keys_w = keys + ["_b"]
    else:
        keys_w = keys
    w = Window.partitionBy(*keys_w).orderBy(F.col(ts))
    item = F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v"))
    extra = []
    if exog:
        hz = [F.transform(F.collect_list(F.struct(F.col(c).cast("double").alias("x"))).over(w.rowsBetween(1, horizon)),
                          lambda s: s["x"]) for c in exog]
        extra = [F.concat(*hz).alias("exog_horizon")]
    own = [F.col("_own")] if bucket is not None else []
    out = src.select(*keys, F.col(ts).alias("origin"),
                     F.collect_list(item).over(w.rowsBetween(-(context - 1), 0)).alias("context"),
                     F.collect_list(item).over(w.rowsBetween(1, horizon)).alias("horizon"), *extra, *own)
    if bucket is not None:
        out = out.where(F.col("_own")).drop("_own")
    if full_only:
        out = out.where((F.size("context") == context) & (F.size("horizon") == horizon))
    return out
