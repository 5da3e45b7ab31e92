"""Session settings, sizing, and tables written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that matter for the plans in this package.  AQE chooses broadcast
#: joins from measured sizes, splits skewed join partitions and coalesces small
#: shuffle partitions, so no operator needs to guess a size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: Input bytes one shuffle partition should stand for.
BYTES_PER_PARTITION = 128 * 1024 * 1024


def build_session(app_name: str = "preciario", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of files or folders, asked of the file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for path in paths:
        where = hadoop.Path(path)
        total += where.getFileSystem(conf).getContentSummary(where).getLength()
    return total


def size_shuffles(spark: SparkSession, *paths: str) -> int:
    """Set the initial number of shuffle partitions from the size of the input.

    Adaptive execution merges what turns out small, so the number only has to be
    large enough that no partition outgrows an executor.
    """
    wanted = input_bytes(spark, *paths) // BYTES_PER_PARTITION + 1
    partitions = int(max(wanted, spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return partitions


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for shared files; without one, the warehouse, which is shared as well."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table written below the shared folder.

    For a result that several branches of a query use: it is computed once, its
    lineage is cut, it survives the loss of executors, and its size is known to
    the planner.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
