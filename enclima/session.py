"""Spark session settings shared by the library, tests and the bench.

The library never creates sessions on its own inside operators; callers pass
the active ``SparkSession``. ``get_session`` is a convenience for scripts and
tests: UTC session time zone (timestamps are naive local time, see
``TIMESTAMP_NTZ``), ANSI casts on, adaptive execution with skew-join handling,
UI off.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


# Settings for a large cluster (about 100 TB of input, ~1000 executors). Not
# applied automatically; pass ``extra=CLUSTER_CONF`` or set them in the
# cluster's defaults. Reasoning:
# * scans: 512 MB splits keep task counts near 200k for 100 TB of Parquet;
# * shuffles: a high initial partition count that AQE coalesces toward
#   256 MB per partition, so the largest shuffles (fact -> hourly cells)
#   never spill badly and small ones collapse to a few tasks;
# * skew: a partition is split when it is 5x the median and over 1 GB;
# * broadcast: Spark's own estimate decides (default 10 MB); this library
#   forces none but of tables bounded by parameters (trees, clusters).
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "enclima", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    existing = SparkSession.getActiveSession()
    if "spark.checkpoint.dir" not in conf and existing is None and master.startswith("local["):
        # Tests / local runs only: a cluster names its shared folder itself.
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(
            prefix="enclima-ckpt-", dir=os.environ.get("ENCLIMA_SCRATCH", "/tmp"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates, named by ``spark.checkpoint.dir``.

    Unset, it is an error on a cluster (executors would write to their own
    disks); a local session gets one scratch folder for its lifetime."""
    context = spark.sparkContext
    current = context.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = context.getCheckpointDir() or tempfile.mkdtemp(
            prefix="enclima-ckpt-", dir=os.environ.get("ENCLIMA_SCRATCH", "/tmp"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def read_table(spark: SparkSession, base: str, name: str):
    """One driver table (``{base}/{name}.parquet``)."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def materialize(df):
    """Cut the lineage of a frame reused by several jobs.

    The frame is written once as a Parquet table under the shared folder named
    by ``spark.checkpoint.dir`` and read back (columnar, prunable, survives
    executor loss). An RDD ``checkpoint()`` of a non-persisted Dataset would
    compute the plan twice; a local checkpoint would not survive executor
    loss."""
    return materialize_at(df)[0]


def materialize_at(df):
    """``materialize`` for an intermediate that ends early: (frame, path), to
    be given to ``discard`` once no later job reads it."""
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/enclima-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark, *paths: str) -> None:
    """Delete intermediate tables by path (any Hadoop file system)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
