"""Corpus pipeline: language ID, near-duplicate removal, decontamination,
mixing and sharding of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows as Parquet and rereads them as the next stage's docs. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from enclima.llm.common import read_table, same, save
from enclima.llm.decontaminate import decontaminate
from enclima.llm.language_id import UND, predict, train
from enclima.llm.mixing import mix
from enclima.llm.ngram_join import ngram_join
from enclima.llm.queries import MIX_ROUNDS, MIX_TARGETS, SHARD_BYTES
from enclima.llm.sharding import shard

# A text is rejected if less than this share of its n-grams is in any language.
MIN_LANGUAGE_SHARE = 0.2


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null texts and texts in no learned
    language. The filter is fitted on the labelled rows of ``docs``; without
    any there is nothing to reject by, and only texts without a letter go."""
    model = train(docs.select("doc_id", "text", "lang"))
    pred, score = free_name(docs, "pred"), free_name(docs, "share")
    seen = predict(docs, model, docs.columns, pred=pred, score=score)
    keep = ((F.col(pred) != UND) & (F.col(score) >= MIN_LANGUAGE_SHARE) if model.langs
            else F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)))
    return seen.where(keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked texts: the smallest doc_id
    (of several rows with that id, the one with the smallest hash of id and
    text; wholly equal rows once). Texts of one doc_id that are not linked are
    in groups of their own, so that none goes without a copy kept. Rows without words and rows with a null
    doc_id are linked with nothing and stay."""
    found = ngram_join(docs.select("doc_id", "text")).where("component_id IS NOT NULL AND set_id IS NOT NULL")
    lead = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("lead")).select(
        F.col("lead.doc_id").alias("lead_id"), F.col("lead.key").alias("lead_key"))
    lead, _ = save(lead)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = free_name(docs, "key")
    linked = F.col("doc_id").isNotNull() & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))
    named = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text))
    alone = docs.where(~linked)
    kept = named.where(linked).join(
        lead, (F.col(key) == F.col("lead_key")) & (F.col("doc_id").cast("long") == F.col("lead_id")), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.dropDuplicates(["doc_id", key]).select(*columns).unionByName(alone.select(*columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    hits = free_name(docs, "hits")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"), hits=hits)
    return found.where(F.size(hits) == 0).drop(hits)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by calibrated probabilities."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "text", "lang",
                         "source")
    return mix(packed, MIX_TARGETS, rounds=MIX_ROUNDS).where("mix_kept").select("whole.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard of every document that is left."""
    return shard(docs, SHARD_BYTES)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

# Language ID, the join's component search and BM25 have no SQL form; tests
# compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs, _ = save(stage(spark, docs, sf_dir))
    return docs
