"""Item codes, chapters and region identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from preciario.constants import COMPONENTES, PATRON_ARCHIVO
from preciario.functions.text import trim_all


def natural_key(codigo: Column) -> Column:
    """Sort key that orders 200.1.1 < 200.2 < 200.12; a prefix sorts first."""
    return F.transform(F.split(codigo, "[.]"), lambda part: part.try_cast("long"))


def with_commas(codigo: Column) -> Column:
    """Sheet-name form of a code; numeric cells are accepted, blank gives null."""
    return F.nullif(F.regexp_replace(trim_all(codigo.cast("string")), r"\.", ","), F.lit(""))


def with_dots(hoja: Column) -> Column:
    """Canonical form of a sheet name."""
    return F.regexp_replace(trim_all(hoja), ",", ".")


def chapter_prefix(codigo: Column) -> Column:
    return F.split_part(codigo, F.lit("."), F.lit(1))


def chapter_label(texto: Column) -> Column:
    """``"Capitulo 2\\nExplanaciones"`` as struct(numero, nombre), else null."""
    pattern = r"(?isu)^cap[íi]tulo\s+(\d+)\s*(.*)$"
    plain = F.regexp_replace(texto, r"^\s+|\s+$", "")
    nombre = F.trim(F.regexp_replace(F.regexp_extract(plain, pattern, 2), r"\s+", " "))
    numero = F.nullif(F.regexp_extract(plain, pattern, 1), F.lit("")).try_cast("int")
    return F.when(
        numero.isNotNull() & (nombre != ""),
        F.struct(numero.alias("numero"), nombre.alias("nombre")),
    )


def chapter_number(numero: Column, capitulo: Column) -> Column:
    """Constructive chapter; the first digit of the code stands in when missing."""
    return F.coalesce(numero, F.substring(capitulo, 1, 1).try_cast("int"))


def chapter_name(nombre: Column, numero: Column) -> Column:
    return F.coalesce(nombre, F.concat(F.lit("Capítulo "), numero.cast("string")))


def component_order(componente: Column) -> Column:
    """Ordinal of a component in the printed form (1..4)."""
    position = F.lit(None).cast("int")
    for index, name in reversed(list(enumerate(COMPONENTES, start=1))):
        position = F.when(componente == name, F.lit(index)).otherwise(position)
    return position


def file_name_parts(archivo: Column, pattern: str = PATRON_ARCHIVO) -> Column:
    """Parts of a workbook file name as a struct; null when the pattern fails."""
    name = trim_all(archivo)

    def part(group: int) -> Column:
        return F.regexp_extract(name, pattern, group)

    return F.when(
        name.rlike(pattern),
        F.struct(
            part(1).alias("codigo"),
            part(2).alias("departamentoCrudo"),
            part(3).alias("provinciaCruda"),
            F.concat(part(4), F.lit("-"), part(5)).alias("vigencia"),
        ),
    )
