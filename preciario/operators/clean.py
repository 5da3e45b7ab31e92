"""Table jobs that clean columns: each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.constants import COMPONENTES
from preciario.functions import codes, money, text, units
from preciario.operators.extract import department_name


def clean_cells(df: DataFrame, *columns: str) -> DataFrame:
    """Canonical text: NFC, unix line breaks, single blanks, empty -> null."""
    return df.withColumns({c: text.clean_text(text.to_nfc(F.col(c))) for c in columns})


def split_descriptions(df: DataFrame, column: str = "descripcion") -> DataFrame:
    """Title and scope of a description, with the variants in use: the first
    line as written, the scope without parentheses, the scope on one line."""
    value = F.col(column)
    return df.withColumns(
        {
            "titulo": text.title(value),
            "primeraLinea": text.first_line(value),
            "alcance": text.rest_of_lines(value),
            "alcanceSinParentesis": text.scope_without_parentheses(value),
            "alcanceEnLinea": text.scope_on_one_line(value),
        }
    )


def normalize_codes(df: DataFrame, column: str) -> DataFrame:
    hoja = codes.with_commas(F.col(column))
    return df.withColumns({"hoja": hoja, "codigo": codes.with_dots(hoja)})


def canonical_units(df: DataFrame, column: str) -> DataFrame:
    """Canonical unit, the raw spelling when it differs, and whether it is known."""
    cruda = text.clean_text(F.col(column))
    unidad = units.canonical_unit(cruda)
    return df.withColumns(
        {
            "unidad": unidad,
            "unidadCruda": units.raw_when_different(cruda, unidad),
            "conocida": F.when(cruda.isNotNull(), units.known_unit(cruda).isNotNull()),
        }
    )


def unknown_units(df: DataFrame, column: str) -> DataFrame:
    """Spellings no rule covers, with their frequency."""
    return (
        canonical_units(df, column)
        .where(F.col("conocida") == F.lit(False))
        .groupBy("unidad")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def title_names(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, text.title_case(F.col(column)))


def slugs(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.withColumn(name, text.slugify(*map(F.col, columns)))


def department_prefix(df: DataFrame, column: str = "regionCodigo") -> DataFrame:
    dane = F.substring(column, 1, 2)
    return df.withColumns({"regionCodigoDane": dane, "nombreDepartamento": department_name(dane)})


def chapter_labels(df: DataFrame, column: str) -> DataFrame:
    label = codes.chapter_label(F.col(column))
    return df.withColumns({"capituloNumero": label["numero"], "capituloNombre": label["nombre"]})


def chapters(df: DataFrame) -> DataFrame:
    """Chapter number and name with their fallbacks filled in."""
    numero = codes.chapter_number(F.col("capituloNumero"), F.col("capitulo"))
    return df.withColumns({"capituloNombre": codes.chapter_name(F.col("capituloNombre"), numero), "capituloNumero": numero})


def thin_search_rows(catalog: DataFrame) -> DataFrame:
    """The narrow rows a search table needs."""
    return chapters(catalog).select(
        "codigo",
        text.first_line(F.col("descripcion")).alias("titulo"),
        "unidad",
        F.col("capituloNumero").alias("capitulo"),
        "capituloNombre",
        "mediana",
        "conDato",
    )


# ------------------------------------------------------------ nested documents


def nested_apu(facts: DataFrame, lineas: Column) -> DataFrame:
    """Facts as nested documents; ``lineas`` is an array of line structs."""
    region = F.struct(
        F.col("regionCodigo").alias("codigo"),
        F.col("regionCodigoDane").alias("codigoDane"),
        "departamento",
        "provincia",
        "slug",
    )
    label = F.when(
        F.col("capituloNumero").isNotNull(),
        F.concat(F.lit("Capitulo "), F.col("capituloNumero").cast("string"), F.lit("\n"), "capituloNombre"),
    )
    return facts.select(
        "vigencia",
        "archivo",
        region.alias("region"),
        "codigo",
        label.alias("capitulo"),
        "articulo",
        "clasificacion",
        "descripcion",
        "unidad",
        "unidadCruda",
        F.struct(*COMPONENTES).alias("totales"),
        "costoDirecto",
        F.col("notaFuente").alias("nota"),
        lineas.alias("lineas"),
    )


def flatten_apu(nested: DataFrame) -> DataFrame:
    """Nested item document -> the flat 22-column row, money rounded."""
    label = codes.chapter_label(F.col("capitulo"))
    return nested.select(
        "vigencia",
        "archivo",
        F.col("region.codigo").alias("regionCodigo"),
        F.col("region.codigoDane").alias("regionCodigoDane"),
        "region.departamento",
        "region.provincia",
        "region.slug",
        "codigo",
        codes.chapter_prefix(F.col("codigo")).alias("capitulo"),
        label["numero"].alias("capituloNumero"),
        label["nombre"].alias("capituloNombre"),
        "articulo",
        "clasificacion",
        "descripcion",
        "unidad",
        "unidadCruda",
        *(money.round_money(F.col(f"totales.{c}")).alias(c) for c in COMPONENTES),
        money.round_money(F.col("costoDirecto")).alias("costoDirecto"),
        F.col("nota").alias("notaFuente"),
    )


def _region(struct: str) -> list[Column]:
    return [F.col(f"{struct}.codigo").alias("regionCodigo"), *(F.col(f"{struct}.{c}") for c in ("slug", "departamento", "provincia"))]


def explode_lines(nested: DataFrame) -> DataFrame:
    """One row per line, numbered from 1 in document order.

    ``nested`` has documents with an array ``lineas``, or one row per line as read from streamed documents
    (documento, posicion, elemento), which hold any number of them.
    """
    if "elemento" in nested.columns:
        rows = nested.where(F.col("elemento").isNotNull()).select("documento.vigencia", "documento.region", "documento.codigo", F.col("posicion").cast("int").alias("orden"), F.col("elemento").alias("linea"))
    else:
        rows = nested.select("vigencia", "region", "codigo", F.posexplode("lineas").alias("pos", "linea")).withColumn("orden", F.col("pos") + 1)
    return rows.select(
        "vigencia",
        *_region("region"),
        "codigo",
        "orden",
        "linea.componente",
        F.col("linea.codigo").alias("codigoInsumo"),
        "linea.descripcion",
        "linea.unidad",
        "linea.unidadCruda",
        "linea.cantidad",
        "linea.precioUnitario",
        money.round_money(F.col("linea.subtotal")).alias("subtotal"),
        "linea.porcentaje",
        money.round_money(F.col("linea.base")).alias("base"),
        "linea.distancia",
        "linea.jornal",
        "linea.factorPrestacional",
    )


def explode_supplies(lists: DataFrame) -> DataFrame:
    """One row per supply of nested lists, or of streamed ones (documento, posicion, elemento)."""
    if "elemento" in lists.columns:
        rows = lists.where(F.col("elemento").isNotNull()).select("documento.vigencia", *_region("documento.region"), F.col("elemento").alias("i"))
    else:
        rows = lists.select("procedencia.vigencia", F.explode("insumos").alias("i")).select("vigencia", *_region("i.region"), "i")
    return rows.select(
        "vigencia",
        "regionCodigo",
        "slug",
        "departamento",
        "provincia",
        F.col("i.codigo").alias("codigoInsumo"),
        "i.componente",
        "i.descripcion",
        "i.unidad",
        "i.unidadCruda",
        "i.categoria",
        "i.precio",
        "i.factorPrestacional",
    )
