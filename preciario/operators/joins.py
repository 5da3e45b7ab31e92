"""Joins.  Keys are equalities throughout; AQE picks the physical join from the
measured sizes and splits skewed partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.functions.codes import chapter_name, chapter_number, natural_key
from preciario.operators.extract import department_name


def chapter_map(catalog: DataFrame) -> DataFrame:
    """Code prefix -> constructive chapter; the first item in code order wins."""
    first = F.min_by(F.struct("capituloNumero", "capituloNombre"), natural_key(F.col("codigo")))
    heads = catalog.groupBy("capitulo").agg(first.alias("h"))
    numero = chapter_number(F.col("h.capituloNumero"), F.col("capitulo"))
    return heads.select("capitulo", numero.alias("numero"), chapter_name(F.col("h.capituloNombre"), numero).alias("nombre"))


def join_chapter_map(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach the constructive chapter; unknown prefixes use their first digit."""
    joined = rows.join(mapping, "capitulo", "left")
    numero = chapter_number(F.col("numero"), F.col("capitulo"))
    return joined.withColumns({"nombre": chapter_name(F.col("nombre"), numero), "numero": numero})


def join_national_median(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Priced facts next to the median of their item; a median of 0 drops out."""
    medians = catalog.where(F.col("mediana") > 0).select("codigo", F.col("mediana").alias("medianaNacional"))
    return facts.where(F.col("costoDirecto") > 0).join(medians, "codigo")


def semi_comparable_items(facts: DataFrame, catalog: DataFrame, mapping: DataFrame) -> DataFrame:
    """Catalog items each province is compared with, per chapter.

    ``comparables`` counts the items priced in the province (a left-semi of the
    catalog); without any, the base falls back to the whole catalog chapter.
    """
    priced = facts.where(F.col("costoDirecto") > 0).select("slug", "codigo")
    coded = join_chapter_map(catalog.select("codigo", "capitulo"), mapping).select("codigo", "numero")
    matched = priced.join(coded, "codigo").groupBy("slug", "numero").agg(F.count(F.lit(1)).alias("comparables"))
    present = join_chapter_map(facts.select("slug", "capitulo").distinct(), mapping).select("slug", "numero").distinct()
    whole = coded.groupBy("numero").agg(F.count(F.lit(1)).alias("todos"))
    joined = present.join(matched, ["slug", "numero"], "left").join(whole, "numero", "left")
    comparables = F.coalesce("comparables", F.lit(0))
    base = F.when(comparables > 0, comparables).otherwise(F.coalesce("todos", F.lit(0)))
    return joined.select("slug", "numero", comparables.alias("comparables"), base.alias("base"))


def join_featured(featured: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows of the featured codes, with their place in the list."""
    return featured.select("posicion", "codigo").join(catalog, "codigo")


def join_item_region_breakdown(breakdown: DataFrame, facts: DataFrame, provinces: DataFrame) -> DataFrame:
    """Breakdown, item region and province: all three must exist."""
    costs = facts.select("codigo", "slug", "costoDirecto")
    names = provinces.select("slug", "departamento", "provincia")
    return breakdown.join(costs, ["codigo", "slug"]).join(names, "slug")


def anti_orphans(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Facts without lines and lines without facts: the unmatched rows of both
    sides from one full join of the key sets."""
    keys = ["codigo", "slug"]
    left = facts.select(*keys).withColumn("_f", F.lit(True))
    right = lines.select(*keys).distinct().withColumn("_l", F.lit(True))
    joined = left.join(right, keys, "full_outer").where(F.col("_f").isNull() | F.col("_l").isNull())
    return joined.select(*keys, F.when(F.col("_l").isNull(), "sin líneas").otherwise("sin ítem").alias("lado"))


def cross_item_region(items: DataFrame, regions: DataFrame, rows: int = 16, columns: int = 16) -> DataFrame:
    """All item-region pairs, which is the feature.

    Both sides are dealt onto a grid: an item is copied along its row and a
    region along its column, and they meet by an equi-join on the grid cell.
    ``rows`` times ``columns`` tasks share the work; an item is copied
    ``columns`` times and a region ``rows`` times.
    """

    def deal(df: DataFrame, n: int) -> Column:
        return F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = items.withColumns({"_a": deal(items, rows), "_b": every(columns)})
    right = regions.withColumns({"_b": deal(regions, columns), "_a": every(rows)})
    return left.join(right, ["_a", "_b"]).drop("_a", "_b")


def missing_pairs(facts: DataFrame) -> DataFrame:
    """Expected item-region pairs that are absent from the facts.

    Only items with fewer regions than there are get paired at all.
    """
    keys = facts.select("codigo", "slug").distinct()
    slugs = keys.select("slug").distinct()
    everywhere = slugs.agg(F.count(F.lit(1)).alias("n")).scalar()
    short = keys.groupBy("codigo").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < everywhere).select("codigo")
    return cross_item_region(short, slugs).join(keys, ["codigo", "slug"], "left_anti")


def join_dept_name(rows: DataFrame) -> DataFrame:
    """Canonical department name, else the name that came with the row."""
    return rows.withColumn(
        "nombreDepartamento", F.coalesce(department_name(F.col("regionCodigoDane")), F.col("departamento"))
    )
