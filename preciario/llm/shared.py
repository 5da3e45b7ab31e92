"""Reading tables, schemas as text, and written intermediate tables."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from preciario.session import scratch_path

__all__ = ["ddl", "discard", "free_shuffles", "scratch_path", "table", "written"]

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table written below the shared folder.

    For a result that several branches of a query use: it is computed once, its lineage is cut, it
    survives the loss of executors, and its size is known to the planner.  ``discard`` deletes it once its last reader
    has run; what is left, because a result still reads it, goes when the session's JVM ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    where, system = _folder(df.sparkSession, path)
    system.deleteOnExit(where)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables; nothing that is still to run may read them."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            where, system = _folder(df.sparkSession, path)
            system.delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's context cleaner delete the shuffle files of steps that are written: it acts when the driver collects garbage.

    Otherwise the files of all steps of a long job stay on the executors' disks together.
    """
    spark.sparkContext._jvm.System.gc()
