"""Sharding by extendible hashing.

A document's hash is 60 bits of md5(doc_id). The directory starts with one
bucket; a bucket whose documents exceed the byte limit splits on the next hash
bit, all others stay. A shard is named by its hash prefix (``""`` for a single
bucket, ``010`` and so on).

Sizes are summed once per fine prefix (enough bits for the expected number of
shards and some more), shallower prefixes are summed from those, and a bucket
is the shortest prefix within the limit. Only the documents of prefixes that
are still too large are summed again with more bits.

Documents whose ids have equal hashes cannot be told apart by hash bits: such
a bucket is continued by overflow pages. Rows are dealt to pages by a running
byte sum; the sum is taken first per slice of the bucket's rows (a second hash
over the row), then over the slices, so no page needs the whole bucket in one
task unless its rows are wholly equal; equal rows are counted and their pages
computed from the count. Even pages hold the rows within one limit's length of
the running sum, odd pages the row that straddles two; oversized rows come last.

Only DataFrame and SQL functions are used. Edge cases: a single document over
the limit is a shard of its own, flagged ``oversized``; a null or empty text
has 0 bytes; a null doc_id hashes like the empty string; repeated rows are
kept, each with its shard; an empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, save

BITS = 60
STEP = 12


def hash_bits(doc_id: Column) -> Column:
    """The first 60 bits of md5(doc_id) as a long."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def n_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def _prefix(h: str, depth: Column | int) -> Column:
    d = depth if isinstance(depth, Column) else F.lit(depth)
    return F.shiftright(F.col(h), F.lit(BITS) - d)


def _shiftright(col: Column, n: Column) -> Column:
    return F.call_function("shiftright", col, n.cast("int"))


def directory(sizes: DataFrame, max_bytes: int) -> DataFrame:
    """Buckets of a table (h, b): (depth, prefix, bytes). Buckets at full depth
    may exceed the limit."""
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("b")).first()[0] or 0
    low, paths, found = 0, [], []
    high = min(BITS, max(1, math.ceil(math.log2(max(1, total / max_bytes)))) + 4)
    rest = sizes
    while True:
        fine, path = save(rest.groupBy(_shiftright(F.col("h"), F.lit(BITS - high)).alias("cell"))
                          .agg(F.sum("b").alias("b")))
        paths.append(path)
        levels = (fine.select("b", "cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
                  .groupBy("depth", _shiftright(F.col("cell"), F.lit(high) - F.col("depth")).alias("prefix"))
                  .agg(F.sum("b").alias("bytes")))
        levels, path = save(levels)
        paths.append(path)
        large = levels.where(F.col("bytes") > max_bytes).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = levels.where((F.col("bytes") <= max_bytes) | (F.col("depth") == BITS))
        # a bucket: it fits and its parent doesn't (the root has none)
        kept = (fits.withColumn("parent", F.shiftright("prefix", 1)).join(large, ["depth", "parent"], "left_semi")
                .select("depth", "prefix", "bytes"))
        if low == 0:
            kept = kept.unionByName(fits.where("depth = 0").select("depth", "prefix", "bytes"))
        kept, path = save(kept)
        found.append(kept)
        open_cells, path = save(levels.where((F.col("depth") == high) & (F.col("bytes") > max_bytes))
                                .select(F.col("prefix").alias("cell")))
        paths.append(path)
        if high == BITS or open_cells.isEmpty():
            break
        rest, path = save(sizes.withColumn("cell", _shiftright(F.col("h"), F.lit(BITS - high)))
                          .join(open_cells, "cell", "left_semi").select("h", "b"))
        paths.append(path)
        low, high = high, min(BITS, high + STEP)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    remove(spark, *paths)
    return out


def bit_string(prefix: Column, depth: Column) -> Column:
    """``prefix`` as ``depth`` binary digits."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth.cast("int"), F.lit("0")))


def shard(docs: DataFrame, max_bytes: int) -> DataFrame:
    """(doc_id, n_bytes, shard, page, oversized) per row of ``docs``.

    ``page`` is 0 but for overflow pages of documents with equal hashes."""
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    rows, _ = save(docs.select(F.col("doc_id"), n_bytes().alias("n_bytes"), hash_bits(F.col("doc_id")).alias("h"),
                               F.xxhash64(*[F.col(f"`{c}`") for c in ("doc_id", "text")]).alias("row")))
    buckets = directory(rows.select("h", F.col("n_bytes").alias("b")), max_bytes)
    depths = [r[0] for r in buckets.select("depth").distinct().orderBy("depth").collect()]     # 61 at most
    tagged = rows.withColumn("cand", F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), _shiftright(F.col("h"), F.lit(BITS - d)).alias("prefix"))
        for d in depths]))).select("*", "cand.*").drop("cand") if depths else rows.withColumns(
            {"depth": F.lit(0), "prefix": F.lit(0).cast("long")})
    placed = tagged.join(buckets, ["depth", "prefix"])
    plain = (placed.where(F.col("bytes") <= max_bytes)
             .select("doc_id", "n_bytes", bit_string(F.col("prefix"), F.col("depth")).alias("shard"),
                     F.lit(0).cast("long").alias("page"), F.lit(False).alias("oversized")))
    return plain.unionByName(_pages(placed.where(F.col("bytes") > max_bytes), max_bytes))


def _pages(full: DataFrame, max_bytes: int) -> DataFrame:
    """Overflow pages of buckets whose rows all have one hash."""
    keys = ["h", "doc_id", "n_bytes", "row"]
    equal = full.groupBy(*keys).agg(F.count("*").alias("k"))
    big = F.col("n_bytes") > max_bytes
    equal = equal.withColumns({"sum": F.when(big, F.lit(0)).otherwise(F.col("k") * F.col("n_bytes")),
                               "alone": F.when(big, F.col("k")).otherwise(F.lit(0))})
    # bytes before a row: first by slices of the second hash, then within a slice
    equal = equal.withColumn("slice", F.pmod("row", F.lit(1024)))
    earlier = Window.partitionBy("h").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = (equal.groupBy("h", "slice").agg(F.sum("sum").alias("sum"), F.sum("alone").alias("alone"))
            .withColumns({"sum_before": F.coalesce(F.sum("sum").over(earlier), F.lit(0)),
                          "alone_before": F.coalesce(F.sum("alone").over(earlier), F.lit(0)),
                          "total": F.sum("sum").over(Window.partitionBy("h"))}).drop("sum", "alone"))
    inner = Window.partitionBy("h", "slice").orderBy("row", "doc_id", "n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    placed = (equal.join(base, ["h", "slice"])
              .withColumns({x: F.col(f"{x}_before") + F.coalesce(F.sum(x).over(inner), F.lit(0)) for x in ("sum", "alone")})
              .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
              .withColumn("at", F.col("sum") + F.col("i") * F.col("n_bytes")))
    part = F.expr(f"at div {int(max_bytes)}")
    last = F.expr(f"(at + greatest(n_bytes, 1L) - 1) div {int(max_bytes)}")
    page = (F.when(big, F.expr(f"2 * (total div {int(max_bytes)}) + 2") + F.col("alone") + F.col("i"))
            .otherwise(2 * part + F.when(part == last, F.lit(0)).otherwise(F.lit(1))))
    return placed.select("doc_id", "n_bytes", bit_string(F.col("h"), F.lit(BITS)).alias("shard"),
                         page.cast("long").alias("page"), big.alias("oversized"))
