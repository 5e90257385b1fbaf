"""Joint regression forests (REG-3, REG-4): one forest predicts all targets.

Trees are grown level by level, all trees of all parameter sets and folds at
once. Features are cut into bins at their quantiles. A level is

* one hash aggregate keyed (tree, node, feature, bin) with the row count, the
  weight, and weighted sums and squared sums of all targets;
* one window per (tree, node, feature) that runs these over the bins, and the
  bin with the largest joint reduction of variance (summed over the targets);
* one join that sends the rows of every split node to its children.

So the number of jobs depends on the depth, not on trees, sets, folds or
targets, and nothing but the number of open nodes reaches the driver. Rows are
drawn with Poisson(1) weights from a hash of (row, tree), features of a node by
a hash of (tree, node, feature): a fit is the same in every run.

Stopping rules are ``max_depth``, ``min_samples_split`` and
``min_samples_leaf`` (rows drawn at least once) and no gain left; a tie goes to
the smaller feature position and the smaller threshold. A node's children are
``2 * node`` (value below the threshold) and ``2 * node + 1``.

Missing values: rows with a missing feature or target are left out of the fit;
rows with a missing feature get no prediction. A constant feature is never
split. Nothing to fit on gives no nodes and no predictions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize_at
from .clean import drop_incomplete

BINS = 64
DEEPEST = 60                                    # node numbers are longs
DIGITS = 9                                      # relative gains closer than this are ties
# Cumulative Poisson(1) probabilities of 0, 1, 2, ...
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]

DEFAULTS = dict(num_trees=100, max_depth=None, min_samples_split=2, min_samples_leaf=1, max_features=1.0,
                bootstrap=True)


def features_per_split(max_features, p: int) -> int:
    """Number of features tried at a split: a share, ``sqrt`` or ``log2``."""
    if max_features == "sqrt":
        return max(1, int(math.sqrt(p)))
    if max_features == "log2":
        return max(1, int(math.log2(p)))
    return max(1, int((1.0 if max_features is None else max_features) * p))


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Ascending thresholds per feature: its values at ranks ``i / bins`` (one
    aggregate, bounded sketches), the smallest value left out."""
    aggs = []
    for i, f in enumerate(features):
        c = F.col(f"`{f}`").cast("double")
        aggs += [F.percentile_approx(c, [k / bins for k in range(1, bins)], 10_000).alias(f"q{i}"), F.min(c).alias(f"m{i}")]
    row = df.agg(*aggs).first()
    return [sorted({v for v in (row[f"q{i}"] or []) if v > row[f"m{i}"]}) for i in range(len(features))]


def binned(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``_x``: the bin of every feature (values below the first threshold
    are bin 0)."""
    from pyspark.ml.feature import Bucketizer
    some = [i for i, e in enumerate(edges) if e]
    out = df.withColumns({f"_f{i}": F.col(f"`{features[i]}`").cast("double") for i in some})
    if some:
        out = Bucketizer(splitsArray=[[-math.inf, *edges[i], math.inf] for i in some],
                         inputCols=[f"_f{i}" for i in some], outputCols=[f"_b{i}" for i in some]).transform(out)
    x = [F.col(f"_b{i}").cast("int") if i in set(some) else F.lit(0) for i in range(len(features))]
    return out.withColumn("_x", F.array(*x)).drop(*[f"_{k}{i}" for i in some for k in "fb"])


def _weight(row: Column, tree: Column, seed: int) -> Column:
    """Poisson(1) draw from a hash of row, tree and seed."""
    u = F.shiftrightunsigned(F.xxhash64(row, tree, F.lit(seed)), 11).cast("double") / float(1 << 53)
    w = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        w = F.when(u < POISSON[k], F.lit(k)).otherwise(w)
    return w


def _drawn(tree: Column, node: Column, p: int, m: Column, seed: int) -> Column:
    """``m`` of the ``p`` features, those with the smallest hashes."""
    ranked = F.array_sort(F.array(*[F.struct(F.xxhash64(tree, node, F.lit(i), F.lit(seed)).alias("h"), F.lit(i).alias("f"))
                                    for i in range(p)]))
    return F.transform(F.slice(ranked, F.lit(1), m), lambda s: s["f"])


@dataclass
class ForestSet:
    """Fitted forests of several parameter sets and folds.

    ``trees``: tree, set, fold, number (of the tree in its forest).
    ``nodes``: tree, node, depth, n, weight, feature (position, null at a
    leaf), bin, threshold, prediction (array, one value per target)."""

    features: list[str]
    targets: list[str]
    edges: list[list[float]]
    trees: DataFrame
    nodes: DataFrame
    depth: int
    folds: int
    paths: list[str]

    def discard(self) -> None:
        """Deletes the written nodes."""
        discard(self.nodes.sparkSession, *self.paths)

    def leaves(self, rows: DataFrame, keys: Sequence[str], fold: str | None = None) -> DataFrame:
        """(keys, set, fold, number, prediction) of every row and tree; with
        ``fold`` only the trees of the row's fold. Level by level, an equi-join
        with the splits of that level; how is left to the planner."""
        src = binned(drop_incomplete(rows, self.features), self.features, self.edges)
        cur = src.select(*[F.col(f"`{k}`") for k in keys], "_x",
                         F.col(f"`{fold}`").alias("fold") if fold else F.explode(F.array(*map(F.lit, range(self.folds)))).alias("fold"))
        # one row per tree: bounded by the parameters
        cur = cur.join(F.broadcast(self.trees), "fold").withColumn("node", F.lit(1).cast("long"))
        splits = self.nodes.where("feature IS NOT NULL")
        for d in range(self.depth):
            level = splits.where(F.col("depth") == d).select("tree", "node", "feature", "bin")
            down = 2 * F.col("node") + F.when(F.col("_x")[F.col("feature")] > F.col("bin"), 1).otherwise(0)
            cur = (cur.join(level, ["tree", "node"], "left")
                   .withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(down))
                   .drop("feature", "bin"))
        return (cur.join(self.nodes.select("tree", "node", "prediction"), ["tree", "node"])
                .select(*[F.col(f"`{k}`") for k in keys], "set", "fold", "number", "prediction"))

    def predict(self, rows: DataFrame, keys: Sequence[str], fold: str | None = None,
                num_trees: Sequence[int] | None = None) -> DataFrame:
        """(keys, set, fold, num_trees, prediction): means over the trees. A
        forest's first ``n`` trees are a forest of ``n`` trees, so several sizes
        cost no more than the largest."""
        found = self.leaves(rows, keys, fold)
        means = F.array(*[F.avg(F.col("prediction")[t]) for t in range(len(self.targets))]).alias("prediction")
        if num_trees is None:
            return found.groupBy(*keys, "set", "fold").agg(F.count("*").alias("num_trees"), means)
        sizes = F.array(*[F.lit(int(n)) for n in num_trees])
        return (found.withColumn("num_trees", F.explode(F.filter(sizes, lambda n: n > F.col("number"))))
                .groupBy(*keys, "set", "fold", "num_trees").agg(means))


def _stats(q: int, w: Column) -> list[Column]:
    y = [F.col("_y")[t] for t in range(q)]
    square = y[0] * y[0]
    for v in y[1:]:
        square = square + v * v
    return [F.count("*").alias("n"), F.sum(w).cast("double").alias("weight"), F.sum(w * square).alias("square"),
            *[F.sum(w * v).alias(f"s{t}") for t, v in enumerate(y)]]


def _total(cols: Sequence[Column], weight: Column) -> Column:
    """Sum over the targets of ``sum ** 2 / weight``."""
    out = F.lit(0.0)
    for c in cols:
        out = out + c * c
    return out / weight


def fit_forests(rows: DataFrame, features: Sequence[str], targets: Sequence[str], params: Sequence[dict],
                key: str, fold: str | None = None, folds: int = 1, seed: int = 69, bins: int = BINS) -> ForestSet:
    """Grow the forests of all ``params`` (see ``DEFAULTS``) on ``rows``.

    ``key`` identifies a row for the draws. With ``fold`` every row counts for
    the trees of its fold only (a row may occur once per fold), and each set is
    grown ``folds`` times."""
    spark = rows.sparkSession
    features, targets = list(features), list(targets)
    p, q = len(features), len(targets)
    src = drop_incomplete(rows, features + targets)
    edges = bin_edges(src, features, bins)
    plan = []
    for s, given in enumerate(params):
        a = {**DEFAULTS, **given}
        depth = DEEPEST if a["max_depth"] is None else min(DEEPEST, int(a["max_depth"]))
        for f in range(folds):
            plan += [(len(plan) + i, s, f, i, depth, int(a["min_samples_split"]), int(a["min_samples_leaf"]),
                      features_per_split(a["max_features"], p), bool(a["bootstrap"])) for i in range(int(a["num_trees"]))]
    plan = spark.createDataFrame(plan, "tree int, set int, fold int, number int, max_depth int, min_split int, "
                                       "min_leaf int, tried int, bootstrap boolean")
    base, base_path = materialize_at(binned(src, features, edges).select(
        F.col(f"`{key}`").alias("_key"), "_x", F.array(*[F.col(f"`{t}`").cast("double") for t in targets]).alias("_y"),
        (F.col(f"`{fold}`") if fold else F.lit(0)).alias("fold")))
    weight = F.when(F.col("bootstrap"), _weight(F.col("_key"), F.col("number"), seed)).otherwise(F.lit(1))
    # the plan has one row per tree: bounded by the parameters
    state, state_path = materialize_at(
        base.join(F.broadcast(plan.select("tree", "fold", "number", "bootstrap")), "fold")
        .select("tree", F.lit(1).cast("long").alias("node"), weight.cast("int").alias("_w"), "_x", "_y").where("_w > 0"))
    discard(spark, base_path)

    sums = [f"s{t}" for t in range(q)]
    stats = ["n", "weight", "square", *sums]
    limits = F.broadcast(plan.select("tree", "number", "max_depth", "min_split", "min_leaf", "tried"))
    impurity = F.col("square") - _total([F.col(s) for s in sums], F.col("weight"))
    fresh = state.groupBy("tree", "node").agg(*_stats(q, F.col("_w")))
    table, paths, depth = F.array(*[F.array(*[F.lit(v) for v in e]).cast("array<double>") for e in edges]), [], 0
    leaf_cols = ["tree", "node", "depth", "n", "weight", "feature", "bin", "threshold", "prediction"]
    prediction = F.array(*[F.col(s) / F.col("weight") for s in sums])
    while True:
        # nodes of this level; the open ones may be split
        open_ = ((F.col("n") >= F.col("min_split")) & (F.lit(depth) < F.col("max_depth"))
                 & (F.col("imp") > 1e-12 * F.col("square")))
        level, level_path = materialize_at(
            fresh.join(limits, "tree").withColumn("imp", impurity).withColumn("open", F.coalesce(open_, F.lit(False)))
            .select("tree", "node", *stats, "min_leaf", "imp", "open",
                    F.when(F.col("open"), _drawn(F.col("number"), F.col("node"), p, F.col("tried"), seed)).alias("tried")))
        frontier = level.where("open")
        cells = (state.join(frontier.select("tree", "node", "tried"), ["tree", "node"])
                 .select("tree", "node", "_w", "_x", "_y", F.explode("tried").alias("feature"))
                 .groupBy("tree", "node", "feature", F.col("_x")[F.col("feature")].alias("bin"))
                 .agg(*_stats(q, F.col("_w"))))
        run = Window.partitionBy("tree", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        left = cells.select("tree", "node", "feature", "bin", *[F.sum(c).over(run).alias(f"l_{c}") for c in stats])
        both = left.join(frontier.select("tree", "node", "min_leaf", "imp", *stats), ["tree", "node"])
        rest = {c: F.col(c) - F.col(f"l_{c}") for c in stats}
        gain = (_total([F.col(f"l_{s}") for s in sums], F.col("l_weight")) + _total([rest[s] for s in sums], rest["weight"])
                - _total([F.col(s) for s in sums], F.col("weight")))
        best = (both.where((F.col("l_n") >= F.col("min_leaf")) & (rest["n"] >= F.greatest(F.col("min_leaf"), F.lit(1))))
                .select("tree", "node", F.struct(
                    F.round(gain / F.col("imp"), DIGITS).alias("gain"), (-F.col("feature")).alias("f"),
                    (-F.col("bin")).alias("b"), *[F.col(f"l_{c}") for c in stats]).alias("cut"))
                .groupBy("tree", "node").agg(F.max("cut").alias("cut")).where("cut.gain > 0")
                .select("tree", "node", (-F.col("cut.f")).alias("feature"), (-F.col("cut.b")).alias("bin"),
                        *[F.col(f"cut.l_{c}").alias(f"l_{c}") for c in stats]))
        done, path = materialize_at(
            level.join(best, ["tree", "node"], "left").withColumn("depth", F.lit(depth))
            .withColumn("threshold", F.when(F.col("feature").isNotNull(), table[F.col("feature")][F.col("bin")]))
            .withColumn("prediction", prediction).select(*leaf_cols, *stats[2:], *[f"l_{c}" for c in stats]))
        paths.append(path)
        discard(spark, level_path)
        splits = done.where("feature IS NOT NULL")
        if splits.isEmpty():
            discard(spark, state_path)
            break
        sides = [F.struct((2 * F.col("node")).alias("node"), *[F.col(f"l_{c}").alias(c) for c in stats]),
                 F.struct((2 * F.col("node") + 1).alias("node"), *[(F.col(c) - F.col(f"l_{c}")).alias(c) for c in stats])]
        fresh = splits.select("tree", F.explode(F.array(*sides)).alias("child")).select("tree", "child.*")
        down = 2 * F.col("node") + F.when(F.col("_x")[F.col("feature")] > F.col("bin"), 1).otherwise(0)
        moved, moved_path = materialize_at(
            state.join(splits.select("tree", "node", "feature", "bin"), ["tree", "node"])
            .select("tree", down.alias("node"), "_w", "_x", "_y"))
        discard(spark, state_path)
        state, state_path, depth = moved, moved_path, depth + 1
    nodes = spark.read.parquet(*paths).select(*leaf_cols)
    return ForestSet(features, targets, edges, plan.select("tree", "set", "fold", "number"), nodes, depth, folds, paths)
