"""N-gram Jaccard join: grouped prefix join over word shingles.

A document's set holds its distinct 5-word shingles. Two documents link when
their sets have a Jaccard similarity of 0.8 or more.

* Order: shingles are ordered rare first by a sketch of document counts (a
  fixed number of counters over all documents; its size does not grow), ties
  by hash. Any common order is exact; a rare-first one keeps frequent shingles
  out of the prefixes.
* Prefix: the first ``n - ceil(0.8 n) + 1`` shingles of a set of size n. Linked
  sets share a prefix shingle. Shingles in the prefix of a single set drop out.
* Groups: documents with identical prefixes and size are one group. Group
  pairs that share a prefix shingle are filtered by size and position, then
  expanded to their distinct sets (copies of a set count once) and verified on
  the whole sets.
* Rounds: first every group is paired, for each shared shingle, with the group
  that has the fewest rarer shingles (the one nearest to a common original)
  and with one other, and every member with the first of its group (pairs
  linear in the entries); links are united. Then all pairs of the same
  shingles whose sets are still in different components are verified, so no
  component misses a link. Most pairs of a large group of near copies are in
  one component by then; of the others, those whose parity bits (1024 per set)
  differ too much for a link are not formed.

Edge cases: null and empty texts, and texts of separators only, have empty
sets and link with nothing; fewer than 5 words make one shingle of the whole
sequence; rows with a null doc_id are sized but link with nothing (component
null); rows that share a doc_id are separate sets of one document: they carry
one component, and what is linked with any of them carries it too. ``root``
tells the texts apart: it is equal for sets joined by links of texts alone.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import SHINGLE_WORDS, components, keyed_texts, remove, same, save

SKETCH_BITS = 18
PARITY = 1024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(part, k: int):
    """Sorted distinct shingle hashes of every text of an Arrow slice."""
    data, starts, ends = W.arrow_text(part.column("text"))
    data = LOWER[data]
    ws, we, lo, hi = W.split_words(data, starts, ends)
    units = W.word_hashes(data, ws, we)
    rolled = W.rolling(units, k)
    out = []
    for a, z in zip(lo.tolist(), hi.tolist()):
        n = z - a
        if n >= k:
            out.append(np.unique(rolled[a:z - k + 1]))
        elif n:
            out.append(W.rolling(units[a:z], n) ^ np.uint64(n))
        else:
            out.append(units[:0])
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _counts(batches, k: int):
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for part in W.slices(batch, "text"):
            sets = shingle_sets(part, k)
            if sets:
                total += np.bincount(_slot(np.concatenate(sets)), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "c"])


def count_sketch(texts: DataFrame, k: int) -> np.ndarray:
    """Document counts of all shingles in 2**SKETCH_BITS counters (2 MB)."""
    rows = (texts.select("text").mapInArrow(functools.partial(_counts, k=k), "slot long, c long")
            .groupBy("slot").agg(F.sum("c").alias("c")).toArrow())
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    total[np.asarray(rows.column("slot"))] = np.asarray(rows.column("c"))
    return total


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Parity of the set's elements per counter, as PARITY / 64 longs. Bits
    that differ between two sets are at most their symmetric difference."""
    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


PROFILE = "doc_id long, key long, n long, sid long, gid long, prefix array<long>, bits array<long>"


def _profiles(batches, k: int, percent: int, sketch):
    import xxhash
    order = sketch.value
    for batch in batches:
        for part in W.slices(batch, "text"):
            n, sid, gid, prefix, bits = [], [], [], [], []
            for s in shingle_sets(part, k):
                n.append(len(s))
                if not len(s):
                    for col in (sid, gid, prefix, bits):
                        col.append(None)
                    continue
                ranked = s[np.lexsort((s, order[_slot(s)]))][:prefix_length(len(s), percent)].view(np.int64)
                sid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                gid.append(xxhash.xxh3_64_intdigest(ranked.tobytes(), len(s)) - (1 << 63))
                prefix.append(ranked)
                bits.append(parity_bits(s))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()),
                 pa.array(gid, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "key", "n", "sid", "gid", "prefix", "bits"])


def _sets(batches, k: int):
    for batch in batches:
        for part in W.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column("sid"), pa.array([s.tobytes() for s in shingle_sets(part, k)], pa.binary())],
                ["sid", "items"])


def _verify(batches, percent: int):
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(100 * both >= percent * (len(a) + len(b) - both))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


def _fits(percent: int):
    """Size filter, and the positional bound at a shared prefix shingle: the
    overlap is at most 1 + what is left behind it in the shorter rest."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-9)
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (100 * small >= percent * large) & (rest >= need)


def _near(percent: int):
    """Parity bound: sets that differ in more bits than linked sets differ in
    elements cannot be linked."""
    differ = functools.reduce(lambda a, b: a + b, [
        F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(PARITY // 64)])
    return differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def _linked(texts: DataFrame, profiles: DataFrame, pairs: DataFrame, k: int, percent: int):
    """Verified pairs (a, b) of set ids; sets are read from one document each.
    Returns (links, path)."""
    pairs, path = save(pairs)
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    home = (profiles.where("doc_id IS NOT NULL").join(ends, "sid").groupBy("sid")
            .agg(F.min(F.struct("doc_id", "key")).alias("home")).select("sid", "home.*"))
    t, h = texts.alias("t"), home.alias("h")
    sets, sets_path = save(
        t.join(h, (F.col("t.key") == F.col("h.key")) & same(F.col("t.doc_id"), F.col("h.doc_id")))
        .select("h.sid", "t.text").mapInArrow(functools.partial(_sets, k=k), "sid long, items binary"))
    sets = sets.groupBy("sid").agg(F.first("items").alias("items"))
    full = (pairs.join(sets.select(F.col("sid").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("sid").alias("b"), F.col("items").alias("y")), "b"))
    out = save(full.select("a", "b", "x", "y").mapInArrow(functools.partial(_verify, percent=percent), "a long, b long"))
    remove(texts.sparkSession, path, sets_path)
    return out


def ngram_join(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of id and text),
    n_shingles, set_id (equal for equal sets), root (equal for sets joined by
    links), component_id (smallest doc_id reachable by links and by texts of
    one doc_id)."""
    spark, texts = docs.sparkSession, keyed_texts(docs)
    sketch = spark.sparkContext.broadcast(count_sketch(texts, k))
    profiles, _ = save(texts.mapInArrow(functools.partial(_profiles, k=k, percent=percent, sketch=sketch), PROFILE))
    usable = profiles.where("sid IS NOT NULL AND doc_id IS NOT NULL")
    # prefix shingles are shuffled as (token, sid, p) only; what a set has besides
    # (group, size) is joined to the entries that are left, a small part of all
    token = usable.select("sid", F.posexplode("prefix").alias("p", "token"))
    # written first, so that the join has plain exchanges and a hot shingle is split
    shared, shared_path = save(token.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"))
                               .where("lo <> hi").select("token"))
    kept, kept_path = save(token.join(shared, "token").select("token", "sid", "p").distinct())
    remove(spark, shared_path)
    shape = usable.groupBy("sid").agg(F.min("gid").alias("gid"), F.min("n").alias("n"))
    shaped, shaped_path = save(kept.join(shape, "sid"))
    hubs, hubs_path = save(shaped.groupBy("token").agg(F.min(F.struct("p", "gid")).gid.alias("first"),
                                                       F.max("gid").alias("last")))
    entries, entries_path = save(shaped.join(hubs, "token").select("token", "sid", "gid", "n", "p", "first", "last"))
    remove(spark, kept_path, shaped_path, hubs_path)
    members, members_path = save(entries.select("gid", "sid", "n").distinct())
    # round 1: groups against the first and the last group of each shingle
    own = entries.select("token", "gid", "n", "p", "first", "last").distinct()
    hub = own.select("token", F.col("gid").alias("gb"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    star = own.select("token", F.col("gid").alias("ga"), F.col("n").alias("na"), F.col("p").alias("pa"),
                      F.explode(F.array_distinct(F.array("first", "last"))).alias("gb")).where("ga <> gb")
    groups = (star.join(hub, ["token", "gb"]).where(_fits(percent))
              .select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).distinct())
    lead = members.groupBy("gid").agg(F.min("sid").alias("lead"))
    one = (groups.join(lead.select(F.col("gid").alias("ga"), F.col("lead").alias("a")), "ga")
           .join(lead.select(F.col("gid").alias("gb"), F.col("lead").alias("b")), "gb").select("a", "b"))
    inside = members.join(lead, "gid").where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    links, links_path = _linked(texts, profiles, one.unionByName(inside).distinct(), k, percent)
    remove(spark, members_path)
    label, label_path = save(components(links))
    # round 2: whatever shares a shingle across components
    placed = (entries.select("token", "sid", "n", "p").join(label.withColumnRenamed("node", "sid"), "sid", "left")
              .select("token", "sid", "n", "p", F.coalesce("root", "sid").alias("root")))
    mixed, mixed_path = save(placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                             .where("lo <> hi").select("token"))
    bits = usable.groupBy("sid").agg(F.first("bits").alias("bits"))
    placed, placed_path = save(placed.join(mixed, "token").join(bits, "sid"))
    remove(spark, entries_path, label_path, mixed_path)
    sides = []
    for side in "ab":
        sides.append(placed.select("token", F.col("sid").alias(side), F.col("n").alias(f"n{side}"),
                                   F.col("p").alias(f"p{side}"), F.col("root").alias(f"r{side}"),
                                   F.col("bits").alias(f"bits_{side}")))
    x, y = sides
    across = (x.join(y, (x.token == y.token) & (F.col("ra") < F.col("rb")) & _fits(percent) & _near(percent))
              .select("a", "b").distinct())
    more, more_path = _linked(texts, profiles, across, k, percent)
    label2, _ = save(components(links.unionByName(more)))
    remove(spark, placed_path, links_path, more_path)
    # the sets of one doc_id: the first against the others
    owned = usable.select("doc_id", "sid")
    first = (owned.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("last")).where("a <> last")
             .select("doc_id", "a"))
    own, own_path = save(owned.join(first, "doc_id").where("sid <> a").select("a", F.col("sid").alias("b")).distinct())
    joined = None
    if not own.isEmpty():
        joined, _ = save(components(label2.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(own)))
    remove(spark, own_path)
    return _labelled(profiles, label2, joined)


def _labelled(profiles: DataFrame, label: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Roots by links (``label``), and component ids by links and by sets of one
    document id (``joined``, if an id has several sets); a row without words goes with its document."""
    rows = profiles.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"))
    empty, full = rows.where("set_id IS NULL"), rows.where("set_id IS NOT NULL")
    home = (full.join(empty.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.min("set_id").alias("at")))
    rows = (full.withColumn("at", F.col("set_id"))
            .unionByName(empty.join(home, "doc_id", "left").select(*rows.columns, "at")))
    node = (rows.join(label.select(F.col("node").alias("at"), "root"), "at", "left")
            .withColumn("whole", F.coalesce("root", "at")))
    if joined is not None:
        node = (node.drop("whole").join(joined.select(F.col("node").alias("at"), F.col("root").alias("whole")), "at", "left")
                .withColumn("whole", F.coalesce("whole", "at")))
    node = node.withColumn("root", F.when(F.col("set_id").isNotNull(), F.coalesce("root", "set_id")))
    least = node.where("whole IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("least"))
    return (node.join(least, "whole", "left")
            .select("doc_id", "key", "n_shingles", "set_id", "root",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")))
