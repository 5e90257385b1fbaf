"""Clustering against a plain integer version; bounds that always hold."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from enclima.llm.centroids import Bounds, Cells, cluster, scaled, with_inertia

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("VEC_ID_", T.LongType())])


def plain(rows, k, rounds, dim, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(q) for _, q in order[:k]]

    def nearest(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(q)[0] for _, q in kept]
        for c in range(len(centroids)):
            members = [q for (_, q), o in zip(kept, own) if o == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    return sorted(((i is None, i or 0), *nearest(q)) for i, q in kept), centroids


def made(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, list(rows[0][1])) for i in range(40)]                  # a group of copies
    rows += [(7, list(rows[3][1])), (7, list(rows[3][1])), (None, list(rows[4][1]))]
    bad = [None, [], [0.5] * (dim - 1), [float("nan")] + [0.0] * (dim - 1), [float("inf")] + [0.0] * (dim - 1),
           [None] + [0.0] * (dim - 1)]
    return rows + [(1000 + i, v) for i, v in enumerate(bad)] + [(2000, [0.0] * dim), (2001, [-0.0] * dim)]


@pytest.mark.parametrize("dim,k,rounds,bits", [(6, 4, 10, 6), (6, 4, 3, 2), (3, 8, 10, 1)])
def test_as_the_plain_version(spark, dim, k, rounds, bits):
    rows = made(150, dim, dim)
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    assigned, centroids = cluster(frame, k=k, rounds=rounds, dim=dim, bits=bits)
    want, want_centroids = plain(rows, k, rounds, dim)
    assert centroids == want_centroids
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in assigned.collect())
    assert got == want
    summed = with_inertia(assigned).collect()
    assert {r.inertia for r in summed} == {sum(w[2] for w in want)}
    for r in summed:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)


def test_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)], SCHEMA)
    assigned, centroids = cluster(frame, k=8, rounds=10, dim=2)
    assert centroids == [[512, 256], [512, 256]]
    assert {r.cluster for r in assigned.collect()} == {0}
    assigned, centroids = cluster(frame.where("vec_id > 5"), k=8, rounds=10, dim=2)
    assert centroids == [] and with_inertia(assigned).collect() == []
    huge = spark.createDataFrame([(1, [1e300, 0.0], 1), (2, [131072.0, 0.0], 1), (3, [131071.0, 0.0], 1)], SCHEMA)
    assert [r.vec_id for r in scaled(huge, 2).collect()] == [3]


def test_bounds_hold_and_decide_something():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (2000, 8)) + 400 * rng.integers(0, 3, (2000, 1))
    for bits in (2, 4, 6):
        inner = [sorted({int(x[:, j].min()), *np.quantile(x[:, j], np.arange(1, 1 << bits) / (1 << bits),
                                                         method="lower").astype(int).tolist()}) for j in range(8)]
        cells = Cells(inner, x.max(axis=0).tolist(), bits)
        import pyarrow as pa
        codes = cells.unpack(pa.array(cells.pack(x), pa.binary()))
        for j in range(8):
            assert (cells.low[j, codes[j]] <= x[:, j]).all() and (x[:, j] <= cells.high[j, codes[j]]).all()
        bounds = Bounds(cells, x[:5].copy())
        told, (near, _) = bounds.decide(codes), bounds.exact(x)
        assert (told[told >= 0] == near[told >= 0]).all()
        assert bits < 6 or (told >= 0).mean() > 0.5
