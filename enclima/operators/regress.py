"""Least squares and random forests (REG-1..4).

OLS / ridge use two distributed passes: the means, then ``X'X`` and ``X'Y`` of
the centred values. Every task folds its rows with numpy (Arrow batches via
``mapInPandas``), the partials are added by a hash aggregate on the array
position, and each key's ``p x p`` system is solved in an executor with a
scaled pseudo-inverse (the minimum-norm solution, as ``lstsq``). Predictions
of one model are a projection with its coefficients as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fold(keys: Sequence[str], p: int, q: int, products: bool):
    """Per task and key: row count and sums, or centred products. ``_m`` holds
    the means in the second pass."""
    def fn(batches):
        import pandas as pd
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(list(keys), sort=False, dropna=False) if keys else [((), pdf)]
            for k, g in groups:
                k = k if isinstance(k, tuple) else (k,)
                x = np.stack(g["_x"].to_numpy()).astype(float).reshape(len(g), p)
                y = np.stack(g["_y"].to_numpy()).astype(float).reshape(len(g), q)
                if products:
                    m = np.asarray(g["_m"].iloc[0], float)
                    x, y = x - m[:p], y - m[p:]
                    part = np.concatenate([[len(g)], (x.T @ x).ravel(), (x.T @ y).ravel()])
                else:
                    part = np.concatenate([[len(g)], x.sum(0), y.sum(0)])
                acc[k] = acc[k] + part if k in acc else part
        rows = [list(k) + [v.tolist()] for k, v in acc.items()]
        cols = list(keys) + ["_s"]
        yield pd.DataFrame(rows, columns=cols) if rows else pd.DataFrame({c: [] for c in cols})
    return fn


def _summed(src: DataFrame, keys: Sequence[str], p: int, q: int, products: bool) -> DataFrame:
    """One array per key: the element-wise sum of the tasks' partials."""
    fields = [f for f in src.schema.fields if f.name in keys]
    schema = T.StructType(fields + [T.StructField("_s", T.ArrayType(T.DoubleType()))])
    parts = src.mapInPandas(_fold(keys, p, q, products), schema)
    cells = (parts.select(*keys, F.posexplode("_s").alias("_i", "_v"))
             .groupBy(*keys, "_i").agg(F.sum("_v").alias("_v")))
    return (cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_c"))
            .select(*keys, F.col("_c._v").alias("_s")))


def solve(n: float, mean: np.ndarray, cxx: np.ndarray, cxy: np.ndarray, ridge: float = 0.0):
    """Least squares from centred products: ``coef (p x q)``, ``intercept
    (q)``. Columns are scaled to unit length first; directions whose eigenvalue
    is below ``p * eps * n`` of the largest are dropped (minimum norm in the
    original units for exactly collinear columns)."""
    p = len(cxx)
    scale = np.sqrt(np.diag(cxx))
    # a constant column differs from its mean by rounding only: no information
    flat = scale <= 1e-12 * np.sqrt(max(n, 1.0)) * np.abs(mean[:p])
    scale[flat] = 1.0
    cxx = np.where(flat[:, None] | flat[None, :], 0.0, cxx)
    cxy = np.where(flat[:, None], 0.0, cxy)
    if ridge:
        coef = np.linalg.solve(cxx + ridge * np.eye(p), cxy)
    else:
        unit = cxx / np.outer(scale, scale)
        val, vec = np.linalg.eigh(unit)
        keep = val > max(p, 1) * np.finfo(float).eps * max(n, 1.0) * val.max(initial=0.0)
        # least squares on the kept directions, then the least-norm member of
        # the solutions that differ only by dropped directions
        base = (vec[:, keep] / val[keep]) @ (vec[:, keep].T @ (cxy / scale[:, None])) / scale[:, None]
        null = vec[:, ~keep] / scale[:, None]
        coef = base - null @ np.linalg.pinv(null) @ base if null.shape[1] else base
    return coef, mean[p:] - mean[:p] @ coef


def fit_groups(df: DataFrame, x: Column, y: Column, p: int, q: int, keys: Sequence[str] = (),
               ridge: float = 0.0) -> DataFrame:
    """``y ~ x`` per key: (keys, _w array<array<double>> q x p, _b array<double>).

    ``x``/``y`` are ``ARRAY<DOUBLE>`` columns of length ``p``/``q`` without
    NULLs. Two passes: means, then products of the centred values, both folded
    in each task and summed by a hash aggregate. Each key's system is solved in
    an executor; nothing reaches the driver. ``ridge`` is per row."""
    keys = list(keys)
    one = keys or ["_all"]
    src = df.select(*([F.col(f"`{k}`") for k in keys] or [F.lit(0).alias("_all")]), x.alias("_x"), y.alias("_y"))
    sums = _summed(src, one, p, q, False)
    mean = sums.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(one)], F.transform(
        F.slice("_s", 2, p + q), lambda v: v / F.col("_s")[0]).alias("_m"))
    match = F.lit(True)
    for i, k in enumerate(one):
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    drop = [f"_k{i}" for i in range(len(one))]
    prod = _summed(src.join(mean, match).drop(*drop), one, p, q, True)
    both = prod.join(mean, match).drop(*drop)

    def fit(batches):
        import pandas as pd
        for pdf in batches:
            w, b = [], []
            for s, m in zip(pdf["_s"], pdf["_m"]):
                s, m = np.asarray(s, float), np.asarray(m, float)
                coef, icpt = solve(s[0], m, s[1:1 + p * p].reshape(p, p), s[1 + p * p:].reshape(p, q),
                                   ridge * max(s[0], 1.0))
                w.append([list(map(float, row)) for row in coef.T])
                b.append(list(map(float, icpt)))
            yield pd.concat([pdf[one].reset_index(drop=True), pd.DataFrame({"_w": w, "_b": b})], axis=1)

    fields = [f for f in src.schema.fields if f.name in one]
    schema = T.StructType(fields + [T.StructField("_w", T.ArrayType(T.ArrayType(T.DoubleType()))),
                                    T.StructField("_b", T.ArrayType(T.DoubleType()))])
    out = both.mapInPandas(fit, schema)
    return out if keys else out.drop("_all")


class LinearModel:
    """Multi-target linear model."""

    def __init__(self, features: Sequence[str], targets: Sequence[str], coef: np.ndarray, intercept: np.ndarray):
        self.features, self.targets = list(features), list(targets)
        self.coef, self.intercept = coef, intercept

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], targets: Sequence[str], ridge: float = 0.0):
        features, targets = list(features), list(targets)
        from .clean import drop_incomplete
        clean = drop_incomplete(df, features + targets)
        x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
        y = F.array(*[F.col(f"`{c}`").cast("double") for c in targets])
        row = fit_groups(clean, x, y, len(features), len(targets), (), ridge).first()      # one small model
        if row is None:
            raise ValueError("no complete rows to fit")
        return cls(features, targets, np.array(row["_w"], float).reshape(len(targets), len(features)).T,
                   np.array(row["_b"], float))

    def prediction(self, target: str) -> Column:
        j = self.targets.index(target)
        expr = F.lit(float(self.intercept[j]))
        for i, f in enumerate(self.features):
            expr = expr + F.lit(float(self.coef[i, j])) * F.col(f"`{f}`").cast("double")
        return expr

    def predict(self, df: DataFrame, suffix: str = "_pred") -> DataFrame:
        return df.withColumns({f"{t}{suffix}": self.prediction(t) for t in self.targets})

    def coefficients(self, spark) -> DataFrame:
        rows = [(t, "intercept", float(self.intercept[j])) for j, t in enumerate(self.targets)]
        rows += [(t, f, float(self.coef[i, j])) for j, t in enumerate(self.targets) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "target string, term string, coef double")


class ForestModel:
    """A fitted ``spark.ml`` forest that remembers its feature columns (any
    names, renamed to positional ones for the vector assembler)."""

    def __init__(self, features: Sequence[str], pipeline_model):
        self.features, self.model = list(features), pipeline_model

    def _prepare(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_f{i}": F.col(f"`{c}`").cast("double") for i, c in enumerate(self.features)})

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``; rows with a missing feature are skipped."""
        return self.model.transform(self._prepare(df)).drop(*[f"_f{i}" for i in range(len(self.features))],
                                                           "_features")


def random_forest(train: DataFrame, features: Sequence[str], target: str, num_trees: int = 50,
                  max_depth: int = 10, feature_subset: str = "0.5", seed: int = 69,
                  min_instances: int = 1, bootstrap: bool = True) -> ForestModel:
    """``spark.ml`` random forest for one target (the reference fits one
    multi-output forest; Spark's forests are single-output, so one per target).
    Tree building is distributed by Spark ML; the fitted model predicts into a
    ``prediction`` column. Grid parameters of the reference available in Spark:
    trees, depth, features per split, minimum leaf size, bootstrap (there is
    no minimum split size)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    from .clean import drop_incomplete
    features = list(features)
    va = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_features",
                         handleInvalid="skip")
    rf = RandomForestRegressor(featuresCol="_features", labelCol="_label", predictionCol="prediction",
                               numTrees=num_trees, maxDepth=max_depth, featureSubsetStrategy=feature_subset,
                               seed=seed, minInstancesPerNode=min_instances, bootstrap=bootstrap)
    fm = ForestModel(features, None)
    src = fm._prepare(drop_incomplete(train, [target])).withColumn("_label", F.col(f"`{target}`").cast("double"))
    fm.model = Pipeline(stages=[va, rf]).fit(src)
    return fm
