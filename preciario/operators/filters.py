"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.constants import PATRON_CODIGO, PATRON_SLUG
from preciario.functions.text import fold_search, trim_all


def filter_applicable(df: DataFrame, value: str = "costoDirecto") -> DataFrame:
    """Drop zeros: they mean "not applicable"."""
    return df.where(F.col(value) > 0)


def applicable_counts(df: DataFrame, keys: list[str], value: str = "costoDirecto") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col(value) > 0).alias("aplica"), F.count_if(~(F.col(value) > 0)).alias("noAplica")
    )


def matches_any(texts: list[Column], query: str) -> Column:
    """Case- and accent-blind substring test; a blank query matches everything."""
    needle = fold_search(trim_all(F.lit(query)))
    hit = F.lit(False)
    for value in texts:
        hit = hit | F.contains(fold_search(value), needle)
    return (needle == "") | F.coalesce(hit, F.lit(False))


def search_any(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    return df.where(matches_any([F.coalesce(c, F.lit("")) for c in columns], query))


def search_item(df: DataFrame, query: str, code: str = "codigo", title: str = "titulo") -> DataFrame:
    return search_any(df, [code, title], query)


def filter_chapter(df: DataFrame, chapter: int | None, query: str = "", code: str = "codigo", title: str = "titulo") -> DataFrame:
    """Chapter equality and text search together; no chapter keeps all."""
    found = search_item(df, query, code, title)
    return found if chapter is None else found.where(F.col("capitulo") == chapter)


def guard_keys(df: DataFrame, code: str = "codigo", slug: str = "slug") -> DataFrame:
    """Only well-formed keys may reach a scan."""
    return df.where(F.col(code).rlike(PATRON_CODIGO) & F.col(slug).rlike(PATRON_SLUG))


def flag_partial(catalog: DataFrame, total: Column) -> DataFrame:
    """Mark items priced in fewer regions than there are."""
    return catalog.withColumn("parcial", F.col("conDato") < total)


def filter_positive_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("subtotal") > 0)
