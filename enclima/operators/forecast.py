"""Window forecasters and forecast post-processing (FCS-1..3, WIN-10, AGG-14).

Forecasts are computed on context windows (``split.context_windows``) as
array expressions; the pretrained neural network of the studied project is not
reproduced. Built-in forecasters:

* ``naive``     - last context value for every step
* ``seasonal``  - value one season earlier (period ``m``)
* ``linear``    - direct multi-horizon linear model on the context vector (one
                  ridge model per series and step),
                  optionally with known future exogenous values appended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regress import fit_groups


def _ctx_values(ctx: str = "context") -> Column:
    return F.transform(F.col(ctx), lambda s: s["v"])


def naive(windows: DataFrame, horizon: int, out: str = "forecast") -> DataFrame:
    last = F.element_at(F.col("context"), -1)["v"]
    return windows.withColumn(out, F.array_repeat(last, horizon))


def seasonal(windows: DataFrame, horizon: int, period: int, out: str = "forecast") -> DataFrame:
    """Step ``h`` (1-based) takes the context value ``period - ((h-1) mod
    period)`` steps back from the origin's season."""
    n = F.size("context")
    steps = F.sequence(F.lit(1), F.lit(horizon))
    return windows.withColumn(out, F.transform(
        steps, lambda h: F.element_at(F.col("context"), n - F.lit(period) + F.pmod(h - 1, F.lit(period)) + 1)["v"]))


def _features(ctx: Column, exog: Column | None) -> Column:
    return ctx if exog is None else F.concat(ctx, exog)


def fit_linear(windows: DataFrame, keys: Sequence[str], context: int, horizon: int,
               exog: Column | None = None, n_exog: int = 0, ridge: float = 1e-3) -> DataFrame:
    """Per series: ``horizon`` ridge models ``y[t+h] ~ context[t]`` fitted on
    the given (training) windows. Returns one row per series: weights ``_w``
    (H x p) and intercepts ``_b`` (H)."""
    keys = list(keys)
    x = _features(_ctx_values(), exog)
    y = F.transform(F.col("horizon"), lambda s: s["v"])
    ok = F.forall(x, lambda v: v.isNotNull()) & F.forall(y, lambda v: v.isNotNull())
    src = windows.where(ok)
    return fit_groups(src, x, y, context + n_exog, horizon, keys, ridge)


def linear(windows: DataFrame, keys: Sequence[str], models: DataFrame, horizon: int,
           exog: Column | None = None, out: str = "forecast") -> DataFrame:
    """Apply fitted linear models: one row of coefficients per series, joined
    on the series key."""
    keys = list(keys)
    x = _features(_ctx_values(), exog)
    j = windows.join(models, keys, "inner") if keys else windows.crossJoin(models)      # without keys: one row
    pred = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.element_at(F.col("_b"), h + 1) + F.aggregate(
        F.zip_with(x, F.element_at(F.col("_w"), h + 1), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))
    return j.withColumn(out, pred).drop("_w", "_b")


def explode_forecasts(fc: DataFrame, keys: Sequence[str], forecast: str = "forecast",
                      date_step: str | None = None) -> DataFrame:
    """One row per (series, origin, step) with the forecast's date (WIN-10).

    The date of step ``h`` is the horizon window's own time stamp when the
    window carries one; ``date_step`` ('day'/'week') computes it from the origin
    instead (for forecasts beyond the observed data)."""
    e = fc.select(*keys, "origin", *([] if date_step else ["horizon"]),
                  F.posexplode(forecast).alias("_p", "predicted"))
    if date_step == "day":
        d = F.date_add(F.col("origin"), F.col("_p") + 1)
    elif date_step == "week":
        d = F.date_add(F.col("origin"), (F.col("_p") + 1) * 7)
    else:
        d = F.element_at(F.col("horizon"), F.col("_p") + 1)["t"]
    return e.select(*keys, "origin", (F.col("_p") + 1).alias("step"), d.alias("Data"), "predicted")


def overlap_mean(exploded: DataFrame, keys: Sequence[str], ts: str = "Data", value: str = "predicted") -> DataFrame:
    """Average the forecasts that different origins made for the same date (AGG-14)."""
    return exploded.groupBy(*keys, ts).agg(F.avg(value).alias(value), F.count(value).alias("n_forecasts"))
