"""Repeated windows, first pass: cores shared by the two substring operators.

Every window of ``length`` units (words or bytes) has one core of ``core``
units (see ``windows.cores``), chosen by content alone. Runs of windows with
one core are rows; only rows whose core occurs again go on.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import remove, same, save, zipped

RUN = "doc_id long, key long, pos long, core long, ctx long"


def units_of(data: np.ndarray, starts, ends, words: bool):
    """(unit hashes, first and past-the-last unit of each document)."""
    if not words:
        return W.BYTE_CODES[data], starts, ends
    ws, we, lo, hi = W.split_words(data, starts, ends)
    return W.word_hashes(data, ws, we), lo, hi


def pack(first, last, at):
    """first unit, run length - 1 and core offset of a run in one long."""
    return (first << 16) | ((last - first) << 8) | (at - first)


def unpack(pos):
    first = pos >> 16
    return first, first + ((pos >> 8) & 255), first + (pos & 255)


def _runs(batches, words: bool, length: int, core: int):
    import xxhash
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part in W.slices(batch, "text"):
            data, starts, ends = W.arrow_text(part.column("text"))
            units, lo, hi = units_of(data, starts, ends, words)
            doc, first, last, at, h = W.cores(units, lo, hi, length, core)
            if not len(doc):
                continue
            raw, width = (memoryview(units).cast("B"), 8) if words else (memoryview(data), 1)
            ctx = np.fromiter((digest(raw[a * width:(z + length) * width]) for a, z in zip(first.tolist(), last.tolist())),
                              np.uint64, len(first))
            off = np.asarray(lo)[doc]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("key").take(take),
                 pa.array(pack(first - off, last - off, at - off)), pa.array(h.view(np.int64)),
                 pa.array(ctx.view(np.int64))], ["doc_id", "key", "pos", "core", "ctx"])


def repeated_runs(texts: DataFrame, words: bool, length: int, core: int):
    """Runs whose core occurs more than once, and their classes.

    Returns ((runs, path), (classes, path)). ``ctx`` hashes all units that the
    run's windows cover, so rows with equal (core, ctx) hold equal windows; a
    class keeps its row count ``n`` and its first row ``rep``. Counting cores
    and forming classes are map-side combined, so groups of copies shrink
    before they are shuffled."""
    runs = texts.mapInArrow(functools.partial(_runs, words=words, length=length, core=core), RUN)
    # written first, so that the join has plain exchanges and a hot core is split
    again, again_path = save(runs.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"))
    kept = save(runs.join(again, "core"))
    remove(texts.sparkSession, again_path)
    classes = save(kept[0].groupBy("core", "ctx").agg(F.count("*").alias("n"),
                                                      F.min(F.struct("doc_id", "key", "pos")).alias("rep")))
    return kept, classes


BODY = "core long, ctx long, n long, doc_id long, key long, pos long, body binary"


def _bodies(batches, words: bool, length: int):
    from .common import unzip
    for batch in batches:
        rows = []
        for doc_id, key, z, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "z", "items"))):
            raw = unzip(z)
            if words:
                data = np.frombuffer(raw, np.uint8)
                one = np.array([0]), np.array([len(data)])
                raw = units_of(data, *one, True)[0].tobytes()
            width = 8 if words else 1
            for it in items:
                first, last, _ = unpack(it["pos"])
                rows.append((it["core"], it["ctx"], it["n"], doc_id, key, it["pos"],
                             raw[first * width:(last + length) * width]))
            if len(rows) > 20000:
                yield _body_batch(rows)
                rows = []
        if rows:
            yield _body_batch(rows)


def _body_batch(rows):
    names = ["core", "ctx", "n", "doc_id", "key", "pos", "body"]
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], names)


def open_bodies(texts: DataFrame, classes: DataFrame, words: bool, length: int):
    """Classes whose core also occurs in another class, with the units that
    their windows cover (word hashes or bytes), read from the class's first
    document. Returns (table, path)."""
    several = classes.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
    ask = (classes.join(several, "core")
           .select("rep.doc_id", "rep.key", F.struct("core", "ctx", "n", "rep.pos").alias("item"))
           .groupBy("doc_id", "key").agg(F.collect_list("item").alias("items")))
    t, q = zipped(texts).alias("t"), ask.alias("q")
    both = (t.join(q, (F.col("t.key") == F.col("q.key")) & same(F.col("t.doc_id"), F.col("q.doc_id")))
            .select("t.doc_id", "t.key", "t.z", "q.items"))
    return save(both.mapInArrow(functools.partial(_bodies, words=words, length=length), BODY))


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every text (compressed) with the spans (start, end) to take out of it.
    A document's list is bounded by its own length."""
    lists = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    t, q = zipped(texts).alias("t"), lists.alias("q")
    return (t.join(q, (F.col("t.key") == F.col("q.key")) & same(F.col("t.doc_id"), F.col("q.doc_id")), "left")
            .select("t.doc_id", "t.z", "q.spans"))


def merged(spans) -> np.ndarray:
    """Spans as sorted disjoint runs, touching ones joined: (k, 2) array."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    a = np.array([(s["start"], s["end"]) for s in spans], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    reach = np.maximum.accumulate(a[:, 1])
    new = np.ones(len(a), bool)
    new[1:] = a[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([a[first, 0], reach[np.append(first[1:], len(a)) - 1]], axis=1)
