"""Joint forests against a plain recursive version."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from enclima.operators.forest import binned, features_per_split, fit_forests
from enclima.plans import flows


def make(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.uniform(-2, 2), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1)
        y1 = (3.0 if a > 0.3 else -1.0) + b + rng.gauss(0, 0.1)
        y2 = 10.0 * (b == 2.0) - (a > 0.3) + rng.gauss(0, 0.1)
        rows.append((i, dt.date(2000, 1, 1) + dt.timedelta(days=i), a, b, c, 7.0, y1, y2))
    return rows


SCHEMA = "id int, Data date, `a.x` double, b double, c double, flat double, y1 double, y2 double"
FEATURES, TARGETS = ["a.x", "b", "c", "flat"], ["y1", "y2"]


def plain_tree(x, y, edges, depth, max_depth, min_split, min_leaf, node=1, out=None):
    out = {} if out is None else out
    n = len(x)
    impurity = ((y - y.mean(0)) ** 2).sum()
    best = None
    if depth < max_depth and n >= min_split and impurity > 1e-12 * (y ** 2).sum():
        for f in range(x.shape[1]):
            for b, e in enumerate(edges[f]):
                left = x[:, f] < e
                k = left.sum()
                if k < min_leaf or n - k < max(min_leaf, 1) or k == 0:
                    continue
                gain = (impurity - ((y[left] - y[left].mean(0)) ** 2).sum() - ((y[~left] - y[~left].mean(0)) ** 2).sum())
                score = (round(gain / impurity, 9), -f, -b)
                if score[0] > 0 and (best is None or score > best[0]):
                    best = (score, f, e, left)
    out[node] = (n, best and best[1], best and best[2], tuple(y.mean(0)))
    if best:
        _, f, e, left = best
        plain_tree(x[left], y[left], edges, depth + 1, max_depth, min_split, min_leaf, 2 * node, out)
        plain_tree(x[~left], y[~left], edges, depth + 1, max_depth, min_split, min_leaf, 2 * node + 1, out)
    return out


@pytest.mark.parametrize("max_depth,min_split,min_leaf", [(2, 2, 1), (None, 20, 4)])
def test_one_tree_as_the_plain_version(spark, max_depth, min_split, min_leaf):
    rows = make(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    forest = fit_forests(df, FEATURES, TARGETS, [dict(num_trees=1, max_depth=max_depth, min_samples_split=min_split,
                                                      min_samples_leaf=min_leaf, bootstrap=False)], "Data", bins=16)
    x, y = np.array([r[2:6] for r in rows]), np.array([r[6:] for r in rows])
    want = plain_tree(x, y, forest.edges, 0, max_depth or 60, min_split, min_leaf)
    got = {r.node: r for r in forest.nodes.collect()}
    assert set(got) == set(want)
    for node, (n, f, e, mean) in want.items():
        assert (got[node].n, got[node].feature, got[node].threshold) == (n, f, e)
        assert got[node].prediction == pytest.approx(mean)
    # predictions are the leaf means
    for r in forest.predict(df, ["id"]).collect():
        node = 1
        while want[node][1] is not None:
            node = 2 * node + (x[r.id, want[node][1]] >= want[node][2])
        assert r.prediction == pytest.approx(want[node][3])
    assert forest.edges[3] == []


def test_draws_sizes_and_missing_values(spark):
    rows = make(240)
    test = spark.createDataFrame(make(60, seed=9), SCHEMA)
    df = spark.createDataFrame(rows + [(999, rows[0][1], None, 1.0, 1.0, 7.0, 1.0, 1.0),
                                       (998, rows[0][1], 1.0, 1.0, 1.0, 7.0, None, 1.0)], SCHEMA)
    params = [dict(num_trees=12, max_features=0.5), dict(num_trees=12, max_features="sqrt", min_samples_leaf=10)]
    forest = fit_forests(df, FEATURES, TARGETS, params, "Data")
    again = fit_forests(df.repartition(5), FEATURES, TARGETS, params, "Data")
    assert sorted(map(str, forest.nodes.select("tree", "node", "n", "feature").collect())) == sorted(
        map(str, again.nodes.select("tree", "node", "n", "feature").collect()))
    n = [r.n for r in forest.nodes.where("node = 1").collect()]
    assert len(set(n)) > 5 and all(100 < v < 200 for v in n)            # about 63 % of 240 rows are drawn
    assert forest.nodes.where("tree >= 12 and feature is null").agg(F.min("n")).first()[0] >= 10
    got = forest.predict(test, ["id", "y1", "y2"], num_trees=[3, 12]).collect()
    assert {r.num_trees for r in got} == {3, 12} and len(got) == 60 * 2 * 2
    error = lambda s, k: np.mean([(r.prediction[0] - r.y1) ** 2 for r in got if r.set == s and r.num_trees == k])
    spread = np.var([r.y1 for r in got])
    assert error(0, 12) < 0.1 * spread and error(0, 3) < 0.1 * spread
    part = forest.predict(spark.createDataFrame([(1, None, None, 1.0, 1.0, 7.0, 1.0, 1.0)], SCHEMA), ["id"])
    assert part.count() == 0


def test_grid_of_all_targets(spark):
    from enclima.operators.split import train_test_split
    frame = train_test_split(spark.createDataFrame(make(240), SCHEMA), "Data", 0.2)
    out = flows.rf_grid(frame, TARGETS, FEATURES, dict(num_trees=[2, 4], max_depth=[1, 5]), n_splits=3, bootstrap=False)
    rows = out.collect()
    assert len(rows) == 2 * 2 * 3 and sum(r.best for r in rows) == 3
    best = next(r for r in rows if r.best)
    assert best.max_depth == 5 and best.mean_rmse == min(r.mean_rmse for r in rows)
    for r in rows:
        own = [q.rmse for q in rows if (q.num_trees, q.max_depth) == (r.num_trees, r.max_depth)]
        assert r.mean_rmse == pytest.approx(sum(own) / 3)


def test_features_per_split_and_bins(spark):
    assert [features_per_split(m, 24) for m in ("sqrt", "log2", 0.5, 1.0, None)] == [4, 4, 12, 24, 24]
    df = spark.createDataFrame([(float(v),) for v in range(5)], "`v.w` double")
    out = binned(df, ["v.w"], [[1.0, 3.0]]).collect()
    assert [r._x[0] for r in sorted(out)] == [0, 1, 1, 2, 2]


def test_nothing_to_fit_on(spark):
    empty = spark.createDataFrame([], SCHEMA)
    forest = fit_forests(empty, FEATURES, TARGETS, [dict(num_trees=2)], "Data")
    assert forest.nodes.count() == 0
    assert forest.predict(spark.createDataFrame(make(3), SCHEMA), ["id"]).count() == 0
