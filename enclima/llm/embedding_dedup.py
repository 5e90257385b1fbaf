"""Embedding near-dedup: vectors meet in regions of the sphere.

Equal vectors are one class. A class belongs to a few regions of ``regions``,
so many that vectors whose cosine is just the threshold meet with probability
``RECALL``, nearer ones more often; that holds for any table. First only
sketches of half a byte per component go to the regions, and every region names
its members that have a near sketch. Those are sent to these regions again as
whole vectors and are linked there.

A region of whole vectors is a shard. A crowded region is dealt to several
shards of about ``shard_rows`` vectors by hash, and each of its vectors queries
each of them. A shard of up to ``GRAPH_ROWS`` vectors is compared as a whole. A
larger one builds a hierarchical navigable small-world graph over its vectors.
On each batch of queries a sample is audited against brute force over
the shard; while its recall is below the target, the beam is doubled and the
batch repeated. A query whose beam would have to be wider than ``WIDEST``, or a
batch whose audit still fails there, is compared with the whole shard: the
exact way for members of large groups. Similarities near the threshold are
verified by cosine in double precision.

A pair counts in the first region that names both. Of its pairs a shard
returns the number of links per query, one of the linked
vectors, and one edge for any two of the shard's vectors that a query joins
for the first time: rows grow with queries and vectors, not with the pairs of a
group. Outside the graphs a link counts at both ends.

A shard's vectors are the task's memory. Queries are streamed. Sketches of a
region with more than ``shard_rows`` members are not compared, all go on.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (0 links, own component, kept); vectors of
different lengths never link; equal vectors link with each other; a repeated
row is a further vector with the same id; a vec_id may be null.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regions
from .common import components, remove, save

SHARD_ROWS = 50_000
GRAPH_ROWS = 1 << 14
MIN_SHARDS = 12
RECALL = 0.99
AUDIT = 8
SLACK = 1e-4                                    # float32 search against the double-precision threshold
QUERIES = 512
WIDEST = 128                                    # widest beam; beyond it a query reads its whole shard
PAIRS = 1 << 20                                 # similarities held at once
SKETCHED = 1 << 15                              # vectors whose sketches are dealt at once
TASK_BYTES = 16 << 20                           # of sketches
TASK_ROWS = 20_000                              # whole vectors, counted once per region
SPREAD = 16                                     # lots of regions per task, so that tasks are even


def _matrix(column) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


class _Shard:
    """``marks``: per vector the earlier regions that name it."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, threshold: float, marks: list | None = None):
        from .hnsw import SmallWorld
        self.ids, self.sizes, self.x, self.threshold = ids, sizes, x, threshold
        self.near = x.astype(np.float32)
        self.graph = SmallWorld(x) if len(x) > GRAPH_ROWS else None
        self.ef = 16
        self.root = np.arange(len(ids))             # what queries have joined so far
        self.order = np.argsort(ids, kind="stable")
        self.earlier = np.unique(np.concatenate([np.zeros(0, np.int64), *(marks or [])]))
        self.marked = self._marked(marks)

    def _marked(self, marks: list | None) -> np.ndarray:
        """0 or 1 per vector and earlier region of the shard's vectors."""
        out = np.zeros((len(marks or []), len(self.earlier)), np.float32)
        if out.size:
            row = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
            mark = np.concatenate(marks)
            at = np.minimum(np.searchsorted(self.earlier, mark), len(self.earlier) - 1)
            known = self.earlier[at] == mark
            out[row[known], at[known]] = 1
        return out

    def _beams(self, x: np.ndarray):
        """Candidate pairs (row, position) of a batch of queries after its
        audit, and the rows that need the whole shard."""
        low = self.threshold - SLACK
        own = np.arange(0, len(x), AUDIT)
        truth = x[own].astype(np.float32) @ self.graph.x.T >= low
        while True:
            r, i, wide = self.graph.within(x, low, self.ef, WIDEST)
            found = np.zeros(truth.shape, bool)
            audited = r % AUDIT == 0
            found[r[audited] // AUDIT, i[audited]] = True
            found[wide[wide % AUDIT == 0] // AUDIT] = True
            if (found & truth).sum() >= RECALL * truth.sum():
                return r, i, wide
            if 2 * self.ef > WIDEST:
                return r[:0], i[:0], np.arange(len(x))
            self.ef *= 2

    def _whole(self, ids: np.ndarray, x: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Links of a few queries with all of the shard's vectors."""
        near = x.astype(np.float32) @ self.near.T
        hit = near >= self.threshold + SLACK
        r, i = np.nonzero((near >= self.threshold - SLACK) & ~hit)
        hit[r, i] = np.einsum("kd,kd->k", x[r], self.x[i]) >= self.threshold
        at = np.minimum(np.searchsorted(self.ids, ids, sorter=self.order), len(self.ids) - 1)
        own = np.flatnonzero(self.ids[self.order[at]] == ids)
        hit[own, self.order[at[own]]] = False
        if marked.size:
            some = np.flatnonzero(hit.any(axis=1))
            hit[some] &= marked[some] @ self.marked.T < 0.5
        return hit

    def links(self, ids: np.ndarray, x: np.ndarray, marks: list | None = None):
        """(cid, other, linked) rows of a batch of queries."""
        marked = self._marked(marks)
        cid, other, linked = [], [], []
        wide = np.arange(len(x))
        if self.graph is not None:
            r, i, wide = self._beams(x)
            ok = np.zeros(len(r), bool)
            for a in range(0, len(r), PAIRS >> 2):
                p, q = r[a:a + (PAIRS >> 2)], i[a:a + (PAIRS >> 2)]
                ok[a:a + (PAIRS >> 2)] = np.einsum("kd,kd->k", x[p], self.x[q]) >= self.threshold
            r, i = r[ok], i[ok]
            order = np.argsort(r, kind="stable")
            r, i = r[order], i[order]
            rows, first = np.unique(r, return_index=True)
            for row, hits in zip(rows.tolist(), np.split(i, first[1:])):
                hits = hits[self.ids[hits] != ids[row]]
                if marked.size:
                    hits = hits[self.marked[hits] @ marked[row] < 0.5]
                self._join(ids[row], hits, cid, other, linked)
        step = max(1, PAIRS // len(self.ids))
        for a in range(0, len(wide), step):
            some = wide[a:a + step]
            hit = self._whole(ids[some], x[some], marked[some] if marked.size else marked)
            for row in np.flatnonzero(hit.any(axis=1)).tolist():
                self._join(ids[some[row]], np.flatnonzero(hit[row]), cid, other, linked)
        return cid, other, linked

    def _join(self, query: int, hits: np.ndarray, cid: list, other: list, linked: list) -> None:
        if not len(hits):
            return
        roots = self.root[hits]
        roots = roots[:1] if (roots == roots[0]).all() else np.unique(roots)
        cid.append(query)
        other.append(self.ids[roots[0]])
        linked.append(self.sizes[hits].sum())
        if len(roots) > 1:
            cid.extend(self.ids[roots[1:]])
            other.extend([self.ids[roots[0]]] * (len(roots) - 1))
            linked.extend([0] * (len(roots) - 1))
            to = np.arange(len(self.ids))
            to[roots] = roots[0]
            self.root = to[self.root]


def _save(df: DataFrame) -> tuple[DataFrame, str]:
    """``save`` of a frame that is not used again: its shuffle files go at
    once, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return save(df)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _entry(dim: int) -> np.dtype:
    return np.dtype([("region", "<u4"), ("cid", "<i8"), ("sketch", "u1", ((dim + 1) // 2,))])


def _sketch(batches, plans: dict[int, tuple[int, int, float]], lots: int):
    """(dim, lot, entries): every class once in each of its regions, all
    entries of a batch that go to one lot of regions in one row."""
    def dealt(held: dict):
        for dim, parts in held.items():
            codes, depth, _ = plans[dim]
            cid, x = (np.concatenate(c) for c in zip(*parts))
            y = regions.rotated(x, codes)
            region = np.concatenate([regions.regions(y[a:a + 4096], codes, depth) for a in range(0, len(y), 4096)])
            entries = np.empty(region.shape, _entry(dim))
            entries["region"], entries["cid"] = region, cid[:, None]
            entries["sketch"] = regions.sketches(y)[:, None]
            entries = entries.ravel()
            lot = entries["region"] % lots
            order = np.argsort(lot, kind="stable")
            entries, lot = entries[order], lot[order]
            cut = np.append(np.flatnonzero(np.append(True, lot[1:] != lot[:-1])), len(lot))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cut) - 1, dim, np.int32)), pa.array(lot[cut[:-1]].astype(np.int32)),
                 pa.array([entries[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["dim", "lot", "entries"])

    held, n = {}, 0
    for batch in batches:
        dims, cid, vec = np.asarray(batch.column("dim")), np.asarray(batch.column("cid")), batch.column("vec")
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            held.setdefault(dim, []).append((cid[at], unit(_matrix(vec.take(pa.array(at)))).astype(np.float32)))
        n += len(cid)
        if n >= SKETCHED:
            yield from dealt(held)
            held, n = {}, 0
    yield from dealt(held)


def _near(x: np.ndarray, least: float) -> np.ndarray:
    """Which of a region's sketches have another one near."""
    found = np.zeros(len(x), bool)
    for a in range(0, len(x), 256):
        for b in range(a, len(x), 1024):
            product = x[a:a + 256] @ x[b:b + 1024].T
            if a == b:
                np.fill_diagonal(product, -np.inf)
            if product.max() >= least:
                hit = product >= least
                found[a:a + 256] |= hit.any(axis=1)
                found[b:b + 1024] |= hit.any(axis=0)
    return found


def _named(batches, plans: dict[int, tuple[int, int, float]], shard_rows: int):
    """(dim, region, cid) of classes that have a near sketch in a region."""
    held = {}
    for batch in batches:
        for dim, entries in zip(batch.column("dim").to_pylist(), batch.column("entries").to_pylist()):
            held.setdefault(dim, []).append(entries)
    for dim in list(held):
        entries = np.frombuffer(b"".join(held.pop(dim)), _entry(dim))
        entries = entries[np.argsort(entries["region"], kind="stable")]
        region = entries["region"]
        found = np.zeros(len(entries), bool)
        cut = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(region))
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            if plans[dim][0] == 1 or b - a > shard_rows:
                found[a:b] = True
            elif b - a > 1:
                found[a:b] = _near(regions.opened(entries["sketch"][a:b], dim), plans[dim][2])
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), dim, np.int32)), pa.array(region[at].astype(np.int64)), pa.array(entries["cid"][at])],
            ["dim", "region", "cid"])


def _search(batches, threshold: float):
    """Rows sorted by (dim, region, shard, query): a shard's vectors, then the
    queries; without any, the shard's vectors are its queries."""
    def lists(column, a, b):
        flat, ends = np.asarray(column.flatten()), np.cumsum(np.asarray(column.value_lengths()))
        return np.split(flat, ends[:-1])[a:b] if len(ends) else []

    def answers(shard, ids, x, marks):
        for c in range(0, len(ids), QUERIES):
            d = c + QUERIES
            out = shard.links(ids[c:d], x[c:d], marks[c:d])
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in out], ["cid", "other", "linked"])

    def own(held):
        if len(held[0]):
            ids, sizes, xs, marks = np.concatenate(held[0]), np.concatenate(held[1]), np.concatenate(held[2]), sum(held[3], [])
            yield from answers(_Shard(ids, sizes, xs, threshold, marks), ids, xs, marks)

    shard, at, held = None, None, ([], [], [], [])
    for batch in batches:
        key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("dim", "region", "shard")], 1)
        is_query = np.asarray(batch.column("is_query").cast(pa.int8())).astype(bool)
        cid, size = np.asarray(batch.column("cid")), np.asarray(batch.column("size"))
        marks = lists(batch.column("marks"), 0, len(cid))
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (is_query[1:] != is_query[:-1])) + 1
        for a, b in zip(np.append(0, cut), np.append(cut, len(cid))):
            if a == b:
                continue
            if at is None or (key[a] != at).any():
                yield from own(held)
                shard, at, held = None, key[a], ([], [], [], [])
            x = unit(_matrix(batch.column("vec").slice(a, b - a)))
            if not is_query[a]:
                for part, col in zip(held, (cid[a:b], size[a:b], x, marks[a:b])):
                    part.append(col)
                continue
            if shard is None:
                if not held[0]:
                    continue
                shard = _Shard(*(np.concatenate(c) for c in held[:3]), threshold, sum(held[3], []))
                held = ([], [], [], [])
            yield from answers(shard, cid[a:b], x, marks[a:b])
    yield from own(held)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, shard_rows: int = SHARD_ROWS,
                    min_shards: int = MIN_SHARDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id,
    embedding)."""
    spark, vec = vectors.sparkSession, F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    kind, real = (kind, vec) if kind in ("float", "double") else ("double", vec.cast("array<double>"))
    high, low = F.array_max(real), F.array_min(real)
    good = (~F.array_contains(real, F.lit(float("nan")).cast(kind))         # null where a component is null
            & (high < float("inf")) & (low > -float("inf")) & ((high != 0) | (low != 0)))
    whole, whole_path = save(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec)
        .withColumn("vec", F.when(good, vec))
        .select("vec_id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("cid"), "vec"))
    classes, classes_path = _save(whole.where("cid IS NOT NULL").groupBy("cid").agg(
        F.first("vec").alias("vec"), F.count("*").alias("size"), F.min("vec_id").alias("least"))
        .withColumn("dim", F.size("vec")))
    rows, _ = save(whole.select("vec_id", "cid"))
    remove(spark, whole_path)

    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    plans = {dim: regions.plan(dim, n, threshold, RECALL) for dim, n in counts.items()}
    size = sum(n * plans[dim][1] * _entry(dim).itemsize for dim, n in counts.items())
    tasks = max(min_shards, math.ceil(size / TASK_BYTES))
    sketched = classes.select("dim", "cid", "vec").mapInArrow(
        functools.partial(_sketch, plans=plans, lots=tasks * SPREAD), "dim int, lot int, entries binary")
    named, named_path = _save(sketched.repartition(tasks, "dim", "lot").mapInArrow(
        functools.partial(_named, plans=plans, shard_rows=shard_rows), "dim int, region long, cid long"))

    crowded = (named.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
               .where("shards > 1"))
    lists = (named.join(crowded, ["dim", "region"], "left").groupBy("cid")
             .agg(F.sort_array(F.collect_list(F.struct("region", F.coalesce("shards", F.lit(1)).alias("shards")))).alias("at"))
             .select("cid", "at", F.col("at.region").alias("regions")))
    work = (classes.join(lists, "cid").select("dim", "cid", "size", "vec", "regions", F.posexplode("at").alias("pos", "at"))
            .select("dim", "at.region", "at.shards", "cid", "size", "vec",
                    F.slice("regions", F.lit(1), F.col("pos")).alias("marks")))
    own = F.pmod(F.xxhash64("cid", F.lit(3)), F.col("shards").cast("long")).cast("int")
    lots = F.concat(F.array(F.struct(own.alias("shard"), F.lit(False).alias("is_query"))), F.when(
        F.col("shards") > 1, F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda i: F.struct(
            i.alias("shard"), F.lit(True).alias("is_query")))).otherwise(F.array()))
    work = (work.withColumn("to", F.explode(lots))
            .select("dim", "region", "to.shard", "to.is_query", "cid", "size", "marks", "vec"))
    dealt = (work.repartition(max(min_shards, math.ceil(named.count() / TASK_ROWS)), "dim", "region", "shard")
             .sortWithinPartitions("dim", "region", "shard", "is_query", "cid"))
    found, found_path = _save(dealt.mapInArrow(functools.partial(_search, threshold=threshold),
                                              "cid long, other long, linked long"))
    label, _ = save(components(found, "cid", "other"))
    degree = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    state = (classes.select("cid", "size", "least").join(degree, "cid", "left")
             .join(label.select(F.col("node").alias("cid"), "root"), "cid", "left")
             .withColumn("root", F.coalesce("root", "cid")))
    lead = state.groupBy("root").agg(F.min("least").alias("component_id"))
    state, _ = _save(state.join(lead, "root")
                    .select("cid", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"))
    out = (rows.select("vec_id", "cid").join(state, "cid", "left")
           .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                   F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")))
    remove(spark, classes_path, named_path, found_path)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
