"""Long <-> wide reshapes (RSH-*, AGG-1, AGG-20, AGG-21, PRJ-7, SET-1).

Pivots are written as *conditional aggregation* grouped on the time column
only: ``sum(CASE WHEN key = v THEN value END)`` per output column. That is one
hash aggregate with map-side partial aggregation and one shuffle on ``ts``,
instead of Spark's generic pivot (aggregate by (ts, key), then by ts). A hot
time key is collapsed by the partial aggregate before the shuffle.

Missing-value rules follow ``pandas.pivot_table(aggfunc='sum')``: a cell with
no source rows is NULL; a cell whose source rows are all NULL is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, key: str | Column) -> list:
    """Pivot keys (AGG-20). Small by construction: one row per series."""
    k = F.col(key) if isinstance(key, str) else key
    rows = df.select(k.alias("_k")).where(F.col("_k").isNotNull()).distinct().orderBy("_k").collect()
    return [r[0] for r in rows]


def _cell_sum(mask: Column, value: Column) -> Column:
    present = F.count(F.when(mask, F.lit(1))) > 0
    return F.when(present, F.coalesce(F.sum(F.when(mask, value)), F.lit(0.0)))


def pivot_masks(df: DataFrame, by: Sequence[str], masks: Mapping[str, Column], value: str,
                how: str = "sum") -> DataFrame:
    """One output column per named mask, aggregated over rows where it holds."""
    v = F.col(value).cast("double")
    exprs = []
    for name, m in masks.items():
        if how == "sum":
            exprs.append(_cell_sum(m, v).alias(name))
        elif how == "mean":
            exprs.append(F.avg(F.when(m, v)).alias(name))
        elif how == "first":
            exprs.append(F.first(F.when(m, v), ignorenulls=True).alias(name))
        else:
            raise ValueError(how)
    return df.groupBy(*by).agg(*exprs)


def pivot_series(df: DataFrame, ts: str | Sequence[str], key: str, value: str,
                 values: Iterable | None = None, prefix: str = "", how: str = "sum") -> DataFrame:
    """Long -> wide: ``pivot_table(index=ts, columns=key, values=value, aggfunc=how)``.

    Column names are ``f"{prefix}{key_value}"`` (PRJ-7). Pass ``values`` to skip
    the distinct-keys job.
    """
    by = [ts] if isinstance(ts, str) else list(ts)
    values = distinct_values(df, key) if values is None else list(values)
    masks = {f"{prefix}{v}": F.col(key) == F.lit(v) for v in values}
    return pivot_masks(df, by, masks, value, how)


def class_subsystem_sets(df: DataFrame, ts: str, cls: str, sub: str, value: str) -> DataFrame:
    """Class totals and class x subsystem sums in one aggregation
    (``GROUPING SETS ((ts, cls), (ts, cls, sub))``); ``sub`` is NULL on the
    class-total rows. All-missing groups sum to 0."""
    return (df.groupingSets([[ts, cls], [ts, cls, sub]], ts, cls, sub)
              .agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias(value)))


def class_subsystem_wide(df: DataFrame, ts: str, cls: str, sub: str, value: str,
                         classes: Iterable | None = None, subs: Iterable | None = None,
                         sep: str = "_") -> DataFrame:
    """Wide hourly generation table: one column per class total and one per
    ``{class}_{subsystem}`` (RSH-3 + JOI-2), produced by a single aggregation
    keyed on ``ts`` rather than one pivot per class plus outer joins."""
    if classes is None or subs is None:
        # one job for both key sets (AGG-20)
        pairs = df.select(cls, sub).distinct().collect()
        classes = sorted({r[0] for r in pairs if r[0] is not None}) if classes is None else list(classes)
        subs = sorted({r[1] for r in pairs if r[1] is not None}) if subs is None else list(subs)
    masks: dict[str, Column] = {}
    for c in classes:
        masks[str(c)] = F.col(cls) == F.lit(c)
    for c in classes:
        for s in subs:
            masks[f"{c}{sep}{s}"] = (F.col(cls) == F.lit(c)) & (F.col(sub) == F.lit(s))
    return pivot_masks(df, [ts], masks, value, "sum")


def multi_measure_pivot(df: DataFrame, ts: str, key: str, measures: Sequence[str],
                        keys: Iterable | None = None, sep: str = "_") -> DataFrame:
    """``groupby([ts, key]).sum().unstack(key)`` with ``{key}_{measure}`` names
    (AGG-1 + RSH-4). The rows are summed per (ts, key) first, one sum per
    measure; only those cells are spread to ``keys`` x ``measures`` columns."""
    keys = distinct_values(df, key) if keys is None else list(keys)
    cells = df.groupBy(ts, key).agg(*[F.coalesce(F.sum(F.col(f"`{m}`").cast("double")), F.lit(0.0)).alias(f"_m{i}")
                                      for i, m in enumerate(measures)])
    return cells.groupBy(ts).agg(*[F.first(F.when(F.col(key) == F.lit(k), F.col(f"_m{i}")), ignorenulls=True)
                                   .alias(f"{k}{sep}{m}") for k in keys for i, m in enumerate(measures)])


def unpivot_wide(df: DataFrame, ids: Sequence[str], cols: Sequence[str] | None = None,
                 key: str = "series", value: str = "value") -> DataFrame:
    """Wide -> long (``melt``); NULL cells are kept as rows."""
    cols = [c for c in df.columns if c not in ids] if cols is None else list(cols)
    typed = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return typed.unpivot(list(ids), [f"`{c}`" for c in cols], key, value)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """``pd.concat`` of frames whose columns match by name; absent columns
    become NULL (SET-1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
