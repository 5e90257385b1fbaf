"""Substring dedup by level-wise doubling.

Repeated windows are found level by level: 5 words, 10 words, 20 words. Only
windows repeated at one length are extended to twice that length, until the
asked length is reached or no candidate is left.

* Level 5: every 20-word window has one 5-word core (chosen by content, so
  equal windows have equal cores at equal offsets). Cores are counted over all
  documents; windows whose core occurs once are out.
* Runs of windows with equal surroundings form classes: every row of a class
  but its first is a repetition as a whole, without looking at its windows.
* Level 10: the cores of classes that share a core with another class are
  extended to 10 words (to the right if that stays in the window, else to both
  sides) and counted again.
* Level 20: survivors are extended to their 20-word windows, grouped, and all
  but the first start of a group are repetitions.

Edge cases: a null or empty text has 0 words; texts shorter than a window keep
all words; rows that share a doc_id but not the text are separate documents
(the smaller hash of id and text is the earlier one); wholly repeated rows are
one document and get the same result; a null doc_id is the smallest id.
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

CORE = 5


def _body_units(batch):
    """Word hashes of all bodies of a batch, and where each body lies."""
    raw, starts, ends = W.arrow_text(batch.column("body"))
    units = np.frombuffer(raw.tobytes(), np.uint64)
    pos = np.asarray(batch.column("pos"))
    first, last, at = unpack(pos)
    return units, starts // 8, first, last, at


def _tens(batches, length: int, core: int):
    """Level 2*core: the 10-word windows around every open core."""
    half = 2 * core
    for batch in batches:
        if not batch.num_rows:
            continue
        units, start, first, last, at = _body_units(batch)
        h = W.rolling(units, half).view(np.int64)
        c = start + at - first
        right = np.flatnonzero(at - last <= length - half)
        left = np.flatnonzero(at - first > length - half)
        row = np.concatenate([right, left])
        side = np.concatenate([np.zeros(len(right), np.int32), np.ones(len(left), np.int32)])
        hash10 = np.concatenate([h[c[right]], h[c[left] - core]])
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("core").take(take), batch.column("ctx").take(take), pa.array(side), pa.array(hash10)],
            ["core", "ctx", "side", "h"])


def _wide(batches, length: int, core: int):
    """Level ``length``: the windows whose 10-word part is repeated."""
    half = 2 * core
    for batch in batches:
        if not batch.num_rows:
            continue
        units, start, first, last, at = _body_units(batch)
        sides = np.asarray(batch.column("sides"))
        h = W.rolling(units, length).view(np.int64)
        count = last - first + 1
        row = np.repeat(np.arange(len(count)), count)
        p = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        off = at[row] - p
        ok = np.where(off <= length - half, sides[row] & 1, sides[row] & 2) > 0
        row, p, off = row[ok], p[ok], off[ok]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("core").take(take), pa.array(off), pa.array(h[start[row] + p - first[row]]),
             batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(p)],
            ["core", "off", "h", "doc_id", "key", "start"])


def repeated_spans(docs: DataFrame, words: int = 20) -> DataFrame:
    """Spans (doc_id, key, start, end), in words, covered by windows of
    ``words`` words whose sequence also starts earlier. Spans may overlap."""
    if words != 4 * CORE:
        raise ValueError(f"the levels {CORE}, {2 * CORE}, {4 * CORE} fit windows of {4 * CORE} words")
    spark, texts = docs.sparkSession, keyed_texts(docs)
    (runs, _), (classes, _) = repeated_runs(texts, True, words, CORE)
    # rows of a class after its first: all their windows start earlier
    r, c = runs.alias("r"), classes.where("n > 1").select("core", "ctx", "rep").alias("c")
    later = (r.join(c, ["core", "ctx"])
             .where(~F.struct("r.doc_id", "r.key", "r.pos").eqNullSafe(F.col("c.rep")))
             .select("r.doc_id", "r.key", F.shiftright("r.pos", 16).alias("start"),
                     (F.shiftright("r.pos", 16) + F.shiftright("r.pos", 8).bitwiseAND(255) + words).alias("end")))
    # first rows: compare with the other classes of their core, level by level
    bodies, bodies_path = open_bodies(texts, classes, True, words)
    tens, tens_path = save(bodies.mapInArrow(functools.partial(_tens, length=words, core=CORE),
                                             "core long, ctx long, side int, h long"))
    again = tens.groupBy("core", "side", "h").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    sides = (tens.join(again, ["core", "side", "h"]).groupBy("core", "ctx")
             .agg(F.bit_or(F.when(F.col("side") == 0, 1).otherwise(2)).alias("sides")))
    wide, _ = save(bodies.join(sides, ["core", "ctx"]).mapInArrow(
        functools.partial(_wide, length=words, core=CORE),
        "core long, off long, h long, doc_id long, key long, start long"))
    remove(spark, bodies_path, tens_path)
    lead, _ = save(wide.groupBy("core", "off", "h").agg(F.min(F.struct("doc_id", "key", "start")).alias("lead"),
                                                        F.count("*").alias("k")).where("k > 1").drop("k"))
    single = (wide.join(lead, ["core", "off", "h"])
              .where(~F.struct("doc_id", "key", "start").eqNullSafe(F.col("lead")))
              .select("doc_id", "key", "start", (F.col("start") + words).alias("end")))
    return later.unionByName(single)


OUT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"


def _cut(batches):
    from .common import unzip
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        ids, out = [], ([], [], [], [])
        for doc_id, z, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "spans"))):
            words = unzip(z).split()
            runs = merged(spans)
            kept, at = [], 0
            for a, b in runs.tolist():
                kept += words[at:a]
                at = b
            kept += words[at:]
            ids.append(doc_id)
            for col, v in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"),
                                    [{"start": a, "end": b} for a, b in runs.tolist()])):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
             pa.array(out[2], pa.string()), pa.array(out[3], kind)], ["doc_id", "n_words", "n_removed", "kept", "spans"])


def substring_dedup(docs: DataFrame, words: int = 20) -> DataFrame:
    """Take out every word covered by a repeated window (see module).

    Returns one row per row of ``docs``: doc_id, n_words, n_removed, kept (the
    words that stay, joined by one space), spans (removed word runs)."""
    return with_spans(keyed_texts(docs), repeated_spans(docs, words)).mapInArrow(_cut, OUT)
