"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from enclima.session import ensure_checkpoint_dir, read_table

__all__ = ["read_table", "save", "remove", "keyed_texts", "zipped", "unzip", "components", "same", "SHINGLE_WORDS",
           "SIMILARITY"]

SHINGLE_WORDS = 5
SIMILARITY = 0.8


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """Write an intermediate table to the shared checkpoint folder and read it
    back (cuts the lineage; survives lost executors). Returns (table, path)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/enclima-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def same(left: Column, right: Column) -> Column:
    """Equality where two nulls are equal."""
    return left.eqNullSafe(right)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) with null texts as empty ones. ``key`` hashes id and
    text, so rows that share an id but not the text stay apart; wholly repeated
    rows share a key and get the same result."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def _zip(batches):
    import zstandard
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        text = b.column("text").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("key"), pa.array([pack(x.as_py()) for x in text], pa.binary())],
            ["doc_id", "key", "z"])


def zipped(texts: DataFrame) -> DataFrame:
    """(doc_id, key, z): texts compressed before they are shuffled."""
    return texts.mapInArrow(_zip, "doc_id long, key long, z binary")


def unzip(z: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(z)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between long ids: (node, root),
    root = smallest id of the component; only nodes with an edge appear.

    Alternating large-star and small-star rounds (each a min per node and a
    join back), every round written to the shared folder, until the edge set no
    longer changes. A hot node is a partial aggregate and a splittable join."""
    spark = edges.sparkSession
    cur, path = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def mark(df):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    state = mark(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large, large_path = save(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        nxt, nxt_path = save(small)
        new = mark(nxt)
        remove(spark, path, large_path)
        cur, path, done, state = nxt, nxt_path, new == state, new
        if done:
            break
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
