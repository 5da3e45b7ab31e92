"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from preciario.constants import INDICES
from preciario.operators.joins import cross_item_region


def union_sources(*tables: DataFrame) -> DataFrame:
    """Rows of all files in one table; columns a file lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def union_key_inventory(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """Every public key: indexes, items, regions and their pairs."""
    items, slugs = distinct_keys(facts, "codigo"), distinct_keys(facts, "slug")
    fixed = spark.createDataFrame(list(INDICES), "url string, prioridad double").select(F.lit("indice").alias("tipo"), "url", "prioridad")

    def keys(rows: DataFrame, kind: str, url: Column, priority: float) -> DataFrame:
        return rows.select(F.lit(kind).alias("tipo"), url.alias("url"), F.lit(priority).alias("prioridad"))

    return union_sources(
        fixed,
        keys(items, "item", F.concat(F.lit("/items/"), "codigo"), 0.8),
        keys(slugs, "provincia", F.concat(F.lit("/provincias/"), "slug"), 0.7),
        keys(cross_item_region(items, slugs), "desglose", F.concat(F.lit("/items/"), "codigo", F.lit("/"), "slug"), 0.5),
    )


def inventory_count(facts: DataFrame) -> DataFrame:
    """Number of public keys, from the dimensions alone, and how many keys a
    published inventory of the same facts must have."""
    n = facts.agg(F.count_distinct("codigo").alias("c"), F.count_distinct("slug").alias("s"))
    fixed = F.lit(len(INDICES)).cast("long")
    return n.select((fixed + F.col("c") + F.col("s") + F.col("c") * F.col("s")).alias("urls"))
