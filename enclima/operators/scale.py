"""Standardisation (SCL-1, SCL-2, AGG-16).

``StandardScaler`` semantics: centre by the mean, divide by the *population*
std (ddof = 0); a constant feature gets scale 1. ``spark.ml.StandardScaler``
uses ddof = 1, so the statistics are computed here with ``stddev_pop``.

The fitted parameters are one row per series/feature - a tiny table joined
back (AQE broadcasts it from its measured size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, keys: Sequence[str], value: str, where: Column | None = None) -> DataFrame:
    """(keys, mean, scale, n) from the rows selected by ``where`` (all rows when
    None - the reference fits on the whole set before splitting)."""
    src = df if where is None else df.filter(where)
    sd = F.stddev_pop(F.col(value))
    return src.groupBy(*keys).agg(
        F.avg(F.col(value)).alias("mean"),
        F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd).alias("scale"),
        F.count(F.col(value)).alias("n"))


def apply_scaler(df: DataFrame, params: DataFrame, keys: Sequence[str], value: str,
                 out: str | None = None, inverse: bool = False) -> DataFrame:
    keys = list(keys)
    p = params.select(*keys, F.col("mean").alias("_mu"), F.col("scale").alias("_sc"))
    if not keys:
        row = params.first()
        p = None
        mu, sc = (row["mean"], row["scale"]) if row else (None, 1.0)
        j = df.withColumns({"_mu": F.lit(mu).cast("double"), "_sc": F.lit(sc).cast("double")})
    else:
        j = df.join(p, keys, "left")
    v = F.col(value)
    expr = v * F.col("_sc") + F.col("_mu") if inverse else (v - F.col("_mu")) / F.col("_sc")
    return j.withColumn(out or value, expr).drop("_mu", "_sc")


def standardize(df: DataFrame, keys: Sequence[str], value: str, fit_where: Column | None = None,
                out: str | None = None) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, keys, value, fit_where), keys, value, out)


def wide_stat_aggs(cols: Sequence[str]) -> list:
    """Aggregates of ``standardize_wide``: mean and population std per column."""
    aggs = []
    for c in cols:
        q = F.col(f"`{c}`")
        aggs += [F.avg(q).alias(f"{c}__mu"), F.stddev_pop(q).alias(f"{c}__sd")]
    return aggs


def standardize_wide(df: DataFrame, cols: Sequence[str], fit_where: Column | None = None,
                     stats: dict | None = None) -> DataFrame:
    """Wide variant: one pass computes mean and population std of every column
    (a single-row aggregate), then one projection scales them. ``stats`` may
    carry those numbers already (e.g. observed while the frame was written)."""
    if stats is None:
        src = df if fit_where is None else df.filter(fit_where)
        st = src.agg(*wide_stat_aggs(cols)).first()  # 2 x len(cols) scalars
    else:
        st = stats
    exprs = {}
    for c in cols:
        mu, sd = st[f"{c}__mu"], st[f"{c}__sd"]
        scale = 1.0 if sd is None or sd == 0 else float(sd)
        exprs[c] = (F.col(f"`{c}`") - F.lit(mu).cast("double")) / F.lit(scale)
    return df.withColumns(exprs)
