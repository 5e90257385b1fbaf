"""Centroid clustering with vector approximations (VA-file).

Components become integers ``floor(scale * x)``. Every vector is also stored as
cells of a few bits per dimension, with marks at the quantiles of that
dimension over all vectors. A round scans the cells only: lookup tables give,
per centroid, a lower and an upper bound of the squared distance; where these
intervals overlap, bounds of the *difference* of two distances (linear in the
vector, so again a table per dimension) are tried. A vector that is decided,
and the same as before, needs nothing else. Full vectors are fetched by key
where the intervals overlap, or where the cluster changes, for then the exact
sums of two clusters change. All arithmetic is in integers, so results don't
depend on the order of additions.

A round keeps no state per vector: the cluster before is found from the cells
and the centroids before, or from the fetched vector. Cells and vectors are
columns of one table that is bucketed by key, so a fetch reads it without a
shuffle; only the keys to fetch and one partial sum per task and cluster move.
The driver holds centroids, marks and sums: numbers bounded by clusters x
dimensions.

Edge cases: vectors that are null, of another length, or hold null or
non-finite components are not clustered and not returned; neither are those
with a scaled component of 2**27 or more, whose squared distances don't fit a
long. Equal vectors and repeated rows are vectors of their own with the same
cluster; a tie goes to the smaller number; with fewer vectors than clusters
every vector starts one; a null vec_id hashes like an empty one; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from enclima.session import ensure_checkpoint_dir

from .common import remove, save

SCALE = 1024
LARGEST = 1 << 27                               # scaled components below it: distances fit a long
BITS = 6
ROWS = 4096                                     # vectors handled at once by numpy
BUCKET_ROWS = 500_000


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


class Cells:
    """Marks of every dimension: cell ``c`` of dimension ``j`` holds the
    integers ``low[j, c] .. high[j, c]``."""

    def __init__(self, marks: list[list[int]], highest: list[int], bits: int):
        self.bits, self.dim = bits, len(marks)
        self.marks = [np.array(m, np.int64) for m in marks]
        self.low = np.zeros((self.dim, 1 << bits), np.int64)
        self.high = np.zeros((self.dim, 1 << bits), np.int64)
        for j, m in enumerate(self.marks):
            self.low[j], self.high[j] = m[-1], highest[j]
            self.low[j, :len(m)] = m
            self.high[j, :len(m)] = np.append(m[1:] - 1, highest[j])

    def pack(self, x: np.ndarray) -> list[bytes]:
        codes = np.stack([np.searchsorted(m, x[:, j], side="right") - 1 for j, m in enumerate(self.marks)], 1)
        bits = (codes[:, :, None] >> np.arange(self.bits - 1, -1, -1)) & 1
        return [row.tobytes() for row in np.packbits(bits.reshape(len(x), -1).astype(np.uint8), axis=1)]

    def unpack(self, column) -> np.ndarray:
        """Cell numbers, one row per dimension."""
        width = (self.dim * self.bits + 7) // 8
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
        bits = np.unpackbits(raw, axis=1)[:, :self.dim * self.bits].reshape(len(column), self.dim, self.bits)
        return np.ascontiguousarray((bits @ (1 << np.arange(self.bits - 1, -1, -1))).T)


class Bounds:
    """Lookup tables of one set of centroids."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.cells, self.centroids = cells, centroids
        low, high = cells.low - centroids[:, :, None], cells.high - centroids[:, :, None]
        self.at_low, self.at_high = low * low, high * high              # squares at the ends of every cell
        self.far = np.maximum(self.at_low, self.at_high)
        self.near = np.where((low <= 0) & (high >= 0), 0, np.minimum(self.at_low, self.at_high))

    @staticmethod
    def _sum(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(table), codes.shape[1]), np.int64)
        for j, c in enumerate(codes):
            total += table[:, j, c]
        return total

    def decide(self, codes: np.ndarray) -> np.ndarray:
        """Nearest centroid of every vector (columns of ``codes``), -1 where
        the cells can't tell."""
        lower, upper = self._sum(self.near, codes), self._sum(self.far, codes)
        best = (lower + upper).argmin(axis=0)
        own = np.arange(len(best))
        number = np.arange(len(lower))[:, None]
        bound = upper[best, own]
        # the other's interval starts behind the best one's end (ties: smaller number)
        apart = (lower > bound) | ((lower == bound) & (number > best)) | (number == best)
        out = np.where(apart.all(axis=0), best, -1)
        open_ = np.flatnonzero(out < 0)
        for b in np.unique(best[open_]):
            rows = open_[best[open_] == b]
            others = np.flatnonzero(np.arange(len(lower)) != b)
            least = np.minimum(self.at_low[others] - self.at_low[b], self.at_high[others] - self.at_high[b])
            gap = self._sum(least, codes[:, rows])
            won = ((gap > 0) | ((gap == 0) & (others[:, None] > b))).all(axis=0)
            out[rows[won]] = b
        return out

    def exact(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroid, squared distance) from full vectors."""
        d = np.stack([np.einsum("nd,nd->n", x - c, x - c) for c in self.centroids])
        near = d.argmin(axis=0)
        return near, d[near, np.arange(len(x))]


def _store(batches, cells: Cells):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            x = _matrix(part.column("q"), cells.dim)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.pack(x), pa.binary())],
                                             [*part.schema.names, "cells"])


def _to_fetch(batches, before: Bounds, now: Bounds):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            codes = now.cells.unpack(part.column("cells"))
            old, new = before.decide(codes), now.decide(codes)
            need = (old < 0) | (old != new)
            yield pa.RecordBatch.from_arrays([part.column("key").filter(pa.array(need))], ["key"])


def _sums(batches, before: Bounds | None, now: Bounds):
    """Per task: (cluster, [vectors, componentwise sums]) gained since the
    centroids before; all vectors if there are none."""
    k, dim = now.centroids.shape
    gained = np.zeros((k, dim + 1), np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            x = _matrix(batch.column("q").slice(a, ROWS), dim)
            new, _ = now.exact(x)
            old = np.full(len(x), -1) if before is None else before.exact(x)[0]
            moved = old != new
            rows = np.column_stack([np.ones(moved.sum(), np.int64), x[moved]])
            np.add.at(gained, new[moved], rows)
            if before is not None:
                np.subtract.at(gained, old[moved], rows)
    some = np.flatnonzero(gained.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(gained[some].tolist(),
                                                                               pa.list_(pa.int64()))], ["cluster", "s"])


def _assign(batches, now: Bounds):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            x = _matrix(part.column("q"), now.centroids.shape[1])
            cluster = now.decide(now.cells.unpack(part.column("cells")))
            open_ = np.flatnonzero(cluster < 0)
            if len(open_):
                cluster[open_] = now.exact(x[open_])[0]
            gap = x - now.centroids[cluster]
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(cluster.astype(np.int32)),
                 pa.array(np.einsum("nd,nd->n", gap, gap))], ["vec_id", "cluster", "distance"])


def scaled(vectors: DataFrame, dim: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): integer vectors of the rows that are clustered."""
    vec = F.col("embedding")
    good = (F.size(vec) == dim) & ~F.exists(
        vec, lambda y: y.isNull() | F.isnan(y) | (F.abs(y.cast("double")) * scale >= float(LARGEST)))
    return vectors.where(F.coalesce(vec.isNotNull() & good, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(vec, lambda y: F.floor(y.cast("double") * scale).cast("int")).alias("q"))


def _cells_of(rows: DataFrame, dim: int, bits: int) -> Cells | None:
    """Marks at the quantiles over all rows. They decide how tight the bounds
    are, never the result: the outermost cells end at the exact extremes."""
    inner = [i / (1 << bits) for i in range(1, 1 << bits)]
    q = [F.col("q")[i] for i in range(dim)]
    first = rows.agg(F.count("*").alias("n"), F.array(*[F.min(x) for x in q]).alias("low"),
                     F.array(*[F.max(x) for x in q]).alias("high"),
                     F.array(*[F.percentile_approx(x, inner, 1000) for x in q]).alias("marks")).first()
    if not first["n"]:
        return None
    marks = [sorted({low, *(m for m in inside if low < m <= high)})
             for low, high, inside in zip(first["low"], first["high"], first["marks"])]
    return Cells(marks, first["high"], bits)


def _bucketed(rows: DataFrame, cells: Cells) -> tuple[DataFrame, str, str]:
    """(table, its name, its folder): key, vec_id, q, cells, bucketed by key."""
    spark = rows.sparkSession
    stored = rows.withColumn("key", F.monotonically_increasing_id()).mapInArrow(
        functools.partial(_store, cells=cells), "vec_id long, q array<int>, key long, cells binary")
    name = f"enclima_va_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/enclima-tables/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored.repartition(buckets, "key").write.bucketBy(buckets, "key").option("path", path).saveAsTable(name)
    return spark.table(name), name, path


def _drop(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove(spark, path)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = SCALE, seed: str = "3:",
            bits: int = BITS) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector, the final centroids).

    Centroids start as the ``k`` vectors with the smallest sha256 of
    ``seed + vec_id``; each of ``rounds`` rounds assigns all vectors and moves
    every non-empty centroid to the componentwise floor of its mean."""
    spark = vectors.sparkSession
    rows, rows_path = save(scaled(vectors, dim, scale))
    cells = _cells_of(rows, dim, bits)
    if cells is None:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = rows.select(digest.alias("digest"), "q").orderBy("digest", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in start], np.int64)
    table, name, path = _bucketed(rows, cells)
    remove(spark, rows_path)

    total = np.zeros((len(centroids), dim + 1), np.int64)
    before = None
    for _ in range(rounds):
        now = Bounds(cells, centroids)
        if before is None:
            needed = table.select("q")
        else:
            keys = table.select("key", "cells").mapInArrow(
                functools.partial(_to_fetch, before=before, now=now), "key long")
            needed = table.select("key", "q").join(keys, "key").select("q")
        gained = (needed.mapInArrow(functools.partial(_sums, before=before, now=now), "cluster int, s array<bigint>")
                  .select("cluster", F.posexplode("s").alias("i", "v"))
                  .groupBy("cluster", "i").agg(F.sum("v").alias("v")).where("v <> 0").collect())
        for r in gained:
            total[r["cluster"], r["i"]] += r["v"]
        count = total[:, :1]
        moved = np.where(count > 0, total[:, 1:] // np.maximum(count, 1), centroids)
        before = now
        if (moved == centroids).all():
            break                               # every further round repeats this one
        centroids = moved
    out, _ = save(table.select("vec_id", "q", "cells").mapInArrow(
        functools.partial(_assign, now=Bounds(cells, centroids)), "vec_id long, cluster int, distance long"))
    _drop(spark, name, path)
    return out, centroids.tolist()


def with_inertia(assigned: DataFrame) -> DataFrame:
    """Adds cluster_inertia and inertia: distances summed over the cluster and
    over all. One row per cluster is read by the driver."""
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    own = F.lit(None).cast("long")
    for c, s in sums.items():
        own = F.when(F.col("cluster") == c, F.lit(s)).otherwise(own)
    return assigned.withColumns({"cluster_inertia": own.cast("long"), "inertia": F.lit(sum(sums.values())).cast("long")})
