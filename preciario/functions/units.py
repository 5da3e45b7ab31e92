"""Canonical units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from preciario.constants import UNIDADES
from preciario.functions.text import is_m3_km


def _table() -> Column:
    return F.create_map(*(F.lit(x) for pair in UNIDADES.items() for x in pair))


def known_unit(cruda: Column) -> Column:
    """Canonical unit of a known spelling, else null."""
    return F.coalesce(
        F.try_element_at(_table(), cruda), F.try_element_at(_table(), F.lower(cruda)), is_m3_km(cruda)
    )


def canonical_unit(cruda: Column) -> Column:
    """Canonical unit; an unknown spelling stands for itself."""
    return F.coalesce(known_unit(cruda), cruda)


def raw_when_different(cruda: Column, unidad: Column) -> Column:
    return F.when(cruda != unidad, cruda)
