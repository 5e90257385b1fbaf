"""Scoring (EVL-1..6, AGG-7, AGG-19, MTH-2).

R2 follows ``sklearn.metrics.r2_score`` (``1 - SSE/SST``; a constant target
gives 1.0 for a perfect fit and 0.0 otherwise). Pairs with a missing actual or
prediction are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import adjusted_r2, month_end


def month_mean(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], out: str = "Data") -> DataFrame:
    """Monthly means labelled by the month's last day (AGG-7)."""
    return df.groupBy(*keys, month_end(F.col(ts)).alias(out)).agg(*[F.avg(c).alias(c) for c in cols])


def regression_metrics(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """(by..., n, r2, mse) - one aggregation pass."""
    pairs = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    err = F.col(actual) - F.col(predicted)
    g = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(F.col(actual)) * F.count("*")).alias("_sst"),
        F.avg(err * err).alias("mse"))
    r2 = (F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))
           .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return g.withColumn("r2", r2).drop("_sse", "_sst")


def with_adjusted_r2(metrics: DataFrame, n, p, out: str = "adj_r2") -> DataFrame:
    """Adjusted R2 with an explicit sample count ``n`` (column name or number)
    and ``p`` predictors (EVL-2)."""
    return metrics.withColumn(out, adjusted_r2("r2", n, p))


def pairs_table(df: DataFrame, keys: Sequence[str], ts: str, actual: str, predicted: str,
                split: str | None = None) -> DataFrame:
    """Long (keys, Data, split, actual, predicted) table behind every chart (EVL-6)."""
    s = F.col(split) if split else F.lit(None).cast("string")
    return df.select(*keys, F.col(ts).alias("Data"), s.alias("split"),
                     F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
