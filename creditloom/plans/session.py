"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when a grouping on the same key follows and needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # A task sorts, joins and groups what one partition expands to, several operators at a time; four times smaller than the default.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}

_local_scratch: str | None = None


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint directory.

    Only a session in one process (``local`` master, as in tests) may do without that setting and gets a
    temporary folder; anywhere else its absence is an error, because executors don't share local folders.
    """
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="creditloom-")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back.

    Used before iterative fits: the lineage is cut at a durable table, so a lost executor re-reads
    a file instead of recomputing joins, and each pass reads only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """How many range buckets an ordered computation is cut into."""
    return min(4096, max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
