"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered only through the threshold (200 bytes), most significant
digit first; a group of equal digits goes on to the next digit, a group of one
drops out. What is still grouped at full depth are the repeated windows.

The suffixes of a document are taken in runs: the windows of one run share a
32-byte core chosen by content (equal windows have equal cores at equal
offsets), and the first digit is that core.

* Digit 1: the core. Runs whose core occurs once drop out.
* Digit 2: the bytes that all windows of a run cover together. Equal ones form
  a class; every window of a class of two or more rows is repeated. Classes of
  one row that share no core with another class drop out.
* Digit 3: windows of a class in blocks of 16 core offsets. All windows of a
  block contain the same 185 bytes; blocks whose 185 bytes occur once drop
  out, and blocks that are equal over their whole extent are repeated.
* Digit 4: the full 200 bytes of each window left.

Every digit is a hash aggregate with map-side combine; no group is gathered in
one task.

Edge cases: null texts are empty; texts shorter than the threshold keep all
bytes; a repeated row counts as a second place where its strings start; rows
that share a doc_id are separate documents; a null doc_id is allowed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .anchors import merged, open_bodies, repeated_runs, unpack, with_spans
from .common import keyed_texts, remove, save

CORE = 32
BLOCK = 16


def _grid(batch):
    """(bytes of all bodies, start of each body, core position, lowest and
    highest core offset of its windows)."""
    raw, starts, _ = W.arrow_text(batch.column("body"))
    first, last, at = unpack(np.asarray(batch.column("pos")))
    return raw, starts + at - first, at - last, at - first


def _blocks(batches, length: int):
    import xxhash
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, c, lo, hi = _grid(batch)
        inner = W.rolling(W.BYTE_CODES[raw], length - BLOCK + 1).view(np.int64)
        count = hi // BLOCK - lo // BLOCK + 1
        row = np.repeat(np.arange(len(count)), count)
        blk = lo[row] // BLOCK + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        o1, o2 = np.maximum(lo[row], blk * BLOCK), np.minimum(hi[row], blk * BLOCK + BLOCK - 1)
        view = memoryview(raw)
        outer = np.fromiter((digest(view[a:b]) for a, b in zip((c[row] - o2).tolist(), (c[row] - o1 + length).tolist())),
                            np.uint64, len(row))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("core").take(take), batch.column("ctx").take(take), batch.column("n").take(take),
             pa.array(blk), pa.array(o1), pa.array(o2), pa.array(inner[c[row] - blk * BLOCK]),
             pa.array(outer.view(np.int64))], ["core", "ctx", "n", "blk", "o1", "o2", "inner", "outer"])


def _full(batches, length: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, c, lo, hi = _grid(batch)
        h = W.rolling(W.BYTE_CODES[raw], length).view(np.int64)
        want = batch.column("blks").to_pylist()
        row, off = [], []
        for i, blks in enumerate(want):
            for b in blks:
                o = np.arange(max(lo[i], b * BLOCK), min(hi[i], b * BLOCK + BLOCK - 1) + 1)
                off.append(o)
                row.append(np.full(len(o), i))
        row, off = np.concatenate(row), np.concatenate(off)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column(x).take(take) for x in ("core", "ctx", "n")] + [pa.array(off), pa.array(h[c[row] - off])],
            ["core", "ctx", "n", "off", "h"])


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """Spans (doc_id, key, start, end), in bytes, covered by ``length``-byte
    strings that also start elsewhere. Spans may overlap."""
    if not CORE + BLOCK < length <= CORE + 255:
        raise ValueError("length must be between 49 and 287 bytes")
    spark, texts = docs.sparkSession, keyed_texts(docs)
    (runs, _), (classes, _) = repeated_runs(texts, False, length, CORE)
    first = F.shiftright("pos", 16)
    many = classes.where("n > 1").select("core", "ctx")
    whole = (runs.join(many, ["core", "ctx"])
             .select("doc_id", "key", first.alias("start"),
                     (first + F.shiftright("pos", 8).bitwiseAND(255) + length).alias("end")))
    # single rows that share a core with another class
    bodies, bodies_path = open_bodies(texts, classes, False, length)
    rows, rows_path = save(bodies.mapInArrow(
        functools.partial(_blocks, length=length),
        "core long, ctx long, n long, blk long, o1 long, o2 long, inner long, outer long"))
    extent = ["core", "blk", "inner", "o1", "o2", "outer"]
    equal, equal_path = save(rows.groupBy(*extent).agg(F.sum("n").alias("total"), F.min("ctx").alias("ctx")))
    group = (equal.groupBy("core", "blk", "inner")
             .agg(F.sum("total").alias("inside"), F.min("total").alias("least"), F.count("*").alias("k")))
    one = rows.where("n = 1")
    block_dup = (one.join(equal.where("total > 1").select(*extent), extent).select("core", "ctx", "o1", "o2"))
    ask = (equal.join(group.where("k > 1 AND least = 1").select("core", "blk", "inner"), ["core", "blk", "inner"])
           .groupBy("core", "ctx").agg(F.collect_list("blk").alias("blks")))
    full, _ = save(bodies.join(ask, ["core", "ctx"]).mapInArrow(
        functools.partial(_full, length=length), "core long, ctx long, n long, off long, h long"))
    again, _ = save(full.groupBy("core", "off", "h").agg(F.count("*").alias("k")).where("k > 1").drop("k"))
    window_dup = (full.where("n = 1").join(again, ["core", "off", "h"])
                  .select("core", "ctx", F.col("off").alias("o1"), F.col("off").alias("o2")))
    at = first + F.col("pos").bitwiseAND(255)
    part = (block_dup.unionByName(window_dup)
            .join(classes.where("n = 1").select("core", "ctx", "rep.*"), ["core", "ctx"])
            .select("doc_id", "key", (at - F.col("o2")).alias("start"), (at - F.col("o1") + length).alias("end")))
    part, _ = save(part)
    remove(spark, bodies_path, rows_path, equal_path)
    return whole.unionByName(part)


OUT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, "
       "spans array<struct<start:long,end:long>>")


def _cut(batches):
    from .common import unzip
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        ids, out = [], ([], [], [], [], [])
        for doc_id, z, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "spans"))):
            raw = unzip(z)
            runs = merged(spans).tolist()
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            ids.append(doc_id)
            for col, v in zip(out, (len(raw), len(raw) - len(kept), len(runs), kept,
                                    [{"start": a, "end": b} for a, b in runs])):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64())] + [pa.array(c, pa.int64()) for c in out[:3]]
            + [pa.array(out[3], pa.binary()), pa.array(out[4], kind)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """Take out every byte covered by a repeated ``length``-byte string.

    Returns one row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans,
    kept (remaining bytes), spans (maximal removed byte runs)."""
    return with_spans(keyed_texts(docs), repeated_spans(docs, length)).mapInArrow(_cut, OUT)
