"""Exact quantiles of groups of any size (AGG-13, AGG-18).

``percentile`` keeps a whole group in one buffer. Here a bounded sketch per
group (``percentile_approx``, error 1 / accuracy) gives values below and above
each wanted rank; a second pass counts the values below and the distinct values
between them, with map-side partial sums, so a hot group is spread over all
tasks; the rank is then found among the distinct values in between: at most
about six in ``accuracy`` of a group, however often a value repeats.

Missing values are left out; a group without values has NULL quantiles. The
result is the linear interpolation between neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """(keys, n, quantiles array): one value per entry of ``probs``, exact.

    Reads ``df`` twice; materialise an expensive input before."""
    keys, margin = list(keys), 3.0 / accuracy
    v = F.col(f"`{value}`").cast("double")
    by = [F.col(f"`{k}`") for k in keys]
    src = df.select(*by, v.alias("_v"))
    ends = [max(0.0, q - margin) for q in probs] + [min(1.0, q + margin) for q in probs]
    about = src.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", ends, accuracy).alias("_q"))
    m, small = len(probs), F.col("_n") <= accuracy
    want = F.array(*[F.struct(
        F.lit(i).alias("i"), ((F.col("_n") - 1) * F.lit(float(q))).alias("rank"),
        # a small group is looked at whole; a quantile of 0 or 1 is an extreme
        F.when(small | F.lit(q - margin <= 0), F.col("_min")).otherwise(F.col("_q")[i]).alias("lo"),
        F.when(small | F.lit(q + margin >= 1), F.col("_max")).otherwise(F.col("_q")[m + i]).alias("hi"))
        for i, q in enumerate(probs)])
    wanted = about.select(*[F.col(f"`{k}`").alias(f"_k{j}") for j, k in enumerate(keys)], "_n", want.alias("_want"))
    match = F.lit(True)
    for j, k in enumerate(keys):
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{j}"))
    cells = (src.where(F.col("_v").isNotNull()).join(wanted, match)
             .select(*by, "_v", F.explode("_want").alias("_w")).where("_v <= _w.hi")
             .groupBy(*by, F.col("_w.i").alias("i"), F.col("_w.rank").alias("rank"),
                      F.when(F.col("_v") >= F.col("_w.lo"), F.col("_v")).alias("x")).agg(F.count("*").alias("c")))
    w = Window.partitionBy(*by, "i").orderBy(F.col("x").asc_nulls_first())
    upto = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.withColumn("end", upto).where("x IS NOT NULL")
    low, high = F.floor("rank"), F.ceil("rank")
    at = lambda r: F.min(F.when(F.col("end") > r, F.col("x")))
    found = (placed.groupBy(*by, "i", "rank").agg(at(low).alias("a"), at(high).alias("b"))
             .withColumn("x", F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a"))))
    lists = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_x")).select(
        *[F.col(f"`{k}`").alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_x.x").alias("quantiles"))
    same = F.lit(True)
    for j, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{j}"))
    return (about.select(*by, F.col("_n").alias("n")).join(lists, same, "left")
            .select(*by, "n", F.coalesce("quantiles", F.array(*[F.lit(None).cast("double")] * m)).alias("quantiles")))
