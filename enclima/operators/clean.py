"""Projections, filters and missing-value operators (PRJ-*, FLT-*, NUL-*, CLP-1, PRE-1)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions import clamp_negative


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename raw columns (e.g. ``din_instante -> Data``); others untouched."""
    return df.withColumnsRenamed(dict(mapping))


def remap_values(df: DataFrame, col: str, mapping: Mapping[str, str], out: str | None = None) -> DataFrame:
    """``Series.replace(dict)``: listed values are replaced, others kept.

    The mapping is a literal ``map`` column, so the lookup stays inside codegen
    (no join, no shuffle).
    """
    if not mapping:
        return df if out is None else df.withColumn(out, F.col(col))
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out or col, F.coalesce(m[F.col(col)], F.col(col)))


def drop_matching(df: DataFrame, substrings: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Drop wide columns whose name contains any of ``substrings``."""
    subs = list(substrings)
    keep = set(keep)
    drop = [c for c in df.columns if c not in keep and any(s in c for s in subs)]
    return df.drop(*drop)


def filter_keys_not_containing(df: DataFrame, key: str, substrings: Iterable[str]) -> DataFrame:
    """Long-form equivalent of ``drop_matching``: remove series by name."""
    cond = F.lit(True)
    for s in substrings:
        cond = cond & ~F.col(key).contains(s)
    return df.filter(cond)


def row_total(df: DataFrame, cols: Iterable[str], out: str = "total") -> DataFrame:
    """``sum(axis=1, skipna=True)``: missing cells skipped, all missing = 0."""
    cols = list(cols)
    expr = F.lit(0.0)
    for c in cols:
        expr = expr + F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
    return df.withColumn(out, expr)


def row_mean(df: DataFrame, cols: Iterable[str], out: str = "mean") -> DataFrame:
    """``mean(axis=1)``: average of the present cells, NULL when none."""
    cols = list(cols)
    total = F.lit(0.0)
    count = F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
        count = count + F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0)
    return df.withColumn(out, F.try_divide(total, count))


def year_range(df: DataFrame, ts: str, after: int | None = None, before: int | None = None,
               inclusive: bool = False) -> DataFrame:
    """``year > after and year < before`` written as a range on the timestamp
    itself so Parquet row-group / partition pruning applies."""
    c = F.col(ts)
    cond = F.lit(True)
    if after is not None:
        lo = after if inclusive else after + 1
        cond = cond & (c >= F.lit(f"{lo}-01-01").cast("date"))
    if before is not None:
        hi = before + 1 if inclusive else before
        cond = cond & (c < F.lit(f"{hi}-01-01").cast("date"))
    return df.filter(cond)


def year_equals(df: DataFrame, ts: str, year: int) -> DataFrame:
    return year_range(df, ts, after=year, before=year, inclusive=True)


def fill_missing(df: DataFrame, cols: Iterable[str] | None = None, value: float = 0.0) -> DataFrame:
    """``fillna(value)`` on numeric columns (names may hold dots or blanks)."""
    num = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer",
                                                                          "short", "decimal")}
    cols = [c for c in (list(cols) if cols is not None else df.columns) if c in num]
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(value).cast(df.schema[c].dataType)) for c in cols})


def drop_incomplete(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """``dropna()``: keep rows with every listed column present."""
    cols = list(cols) if cols is not None else df.columns
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"`{c}`").isNotNull()
    return df.where(cond)


def missing_cells(df: DataFrame, cols: Iterable[str] | None = None) -> Column:
    """Aggregate expression: number of NULL cells over ``cols`` (one pass)."""
    cols = list(cols) if cols is not None else df.columns
    expr = F.lit(0)
    for c in cols:
        expr = expr + F.count_if(F.col(f"`{c}`").isNull())
    return expr


def patch_rows(df: DataFrame, ts: str, patches: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """``df.loc[target] = df.loc[source].values`` for every (target_date,
    source_date) pair of ``patches``, per series where ``keys`` name one. A
    target whose source row is absent keeps its own row."""
    keys = list(keys)
    others = [F.col(f"`{c}`") for c in df.columns if c != ts]
    replaced = (df.join(patches, F.col(ts) == F.col("source_date"), "inner")
                  .select(F.col("target_date").alias(ts), *others))
    found = replaced.select(F.col(ts).alias("_at"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    match = F.col(ts) == F.col("_at")
    for i, k in enumerate(keys):
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    return df.join(found, match, "left_anti").unionByName(replaced)


def clamp_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: clamp_negative(F.col(f"`{c}`")) for c in cols})


def preview(df: DataFrame, ts: str, n: int = 5) -> DataFrame:
    """First ``n`` rows in time order (``head()``); a distributed top-k."""
    return df.orderBy(F.col(ts).asc()).limit(n)
