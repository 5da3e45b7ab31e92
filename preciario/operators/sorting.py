"""Orders in use.  Each returns a globally sorted DataFrame (a range exchange)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.functions.codes import natural_key


def sort_natural_code(df: DataFrame, *then: str, code: str = "codigo") -> DataFrame:
    return df.orderBy(natural_key(F.col(code)), *then)


def locale_key(column: str, locale: str = "es") -> Column:
    """Sort key of a text under a language's alphabet."""
    return F.collate(F.col(column), locale)


def sort_locale(df: DataFrame, *columns: str) -> DataFrame:
    """Spanish alphabet: accents beside their letter, ñ after every n."""
    return df.orderBy(*(locale_key(c) for c in columns))


def province_roster(summary: DataFrame) -> DataFrame:
    """Every region with its median and item count, by department and province."""
    rows = summary.select("regionCodigo", "regionCodigoDane", "departamento", "provincia", "slug", "mediana", "itemsConDato")
    return sort_locale(rows, "departamento", "provincia")


def missing_last_key(value: str, applies: str = "costoDirecto") -> Column:
    """Value where the item applies, else null."""
    return F.when(F.col(applies) > 0, F.col(value))


def sort_missing_last(df: DataFrame, value: str, descending: bool, *then: str) -> DataFrame:
    """Rows that do not apply come last whichever way the value is sorted."""
    key = missing_last_key(value)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *then)


def sort_lines(lines: DataFrame, by: str = "orden", descending: bool = False) -> DataFrame:
    """Lines inside their item and region by position or by another column."""
    key = locale_key(by) if by == "descripcion" else F.col(by)
    return lines.orderBy("codigo", "slug", key.desc() if descending else key.asc(), "orden")


def sort_supply(supplies: DataFrame) -> DataFrame:
    return supplies.orderBy("codigoInsumo", "slug")
