"""Aggregations.

Rule shared by all: 0 means "not applicable" and is left out, an empty group
gives zeros, and money is summed in whole units so no result depends on row order.

Groups by item hold at most one fact per region and use the built-in median.
Every wider group (region, chapter, department, all facts) uses
:func:`preciario.functions.ordering.group_median`, which never sorts or hashes a
whole group in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.constants import COMPONENTES
from preciario.functions.codes import chapter_name, chapter_number, natural_key
from preciario.functions.money import exact_units, from_units, mean_ratio, round_money, sum_money
from preciario.functions.ordering import group_median, positions
from preciario.functions.text import title
from preciario.operators.extract import department_name
from preciario.sources.schemas import COLUMNAS_DESGLOSE

STATS = ("min", "max", "mediana", "promedio")


def _positive(value: str) -> Column:
    return F.when(F.col(value) > 0, F.col(value))


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def positive_stats(value: str = "costoDirecto", median: bool = True) -> list[Column]:
    """min, max, mediana, promedio and conDato of the positive values.

    ``median=False`` leaves the median out for groups that may be large.
    """
    v = _positive(value)
    mean = sum_money(v) / F.count(v)
    out = [
        _zero(round_money(F.min(v))).alias("min"),
        _zero(round_money(F.max(v))).alias("max"),
        _zero(round_money(mean)).alias("promedio"),
        F.count(v).alias("conDato"),
    ]
    if median:
        out.insert(2, _zero(round_money(F.median(v))).alias("mediana"))
    return out


def agg_positive(df: DataFrame, keys: list[str], value: str = "costoDirecto") -> DataFrame:
    """Summary per group for groups of any size; all rows when ``keys`` is empty."""
    simple = df.groupBy(*keys).agg(*positive_stats(value, median=False))
    medians = group_median(df.where(F.col(value) > 0), keys, value).drop("n")
    if not keys:
        # Two one-row results: attach the median as a scalar.
        joined = simple.withColumn("mediana", medians.select("mediana").scalar())
    else:
        joined = simple.join(medians, keys, "left")
    return joined.withColumn("mediana", _zero(round_money(F.col("mediana")))).select(*keys, *STATS, "conDato")


HEAD = ("descripcion", "unidad", "unidadCruda", "capitulo", "capituloNumero", "capituloNombre", "clasificacion")


def head_row(df: DataFrame, keys: list[str], order: Column, columns: tuple[str, ...] = HEAD) -> DataFrame:
    """Attributes of the first row of each group, nulls included."""
    first = F.min_by(F.struct(*columns), order).alias("_h")
    return df.groupBy(*keys).agg(first).select(*keys, "_h.*")


def catalog(facts: DataFrame) -> DataFrame:
    """One row per item: summary over regions, attributes of the first region."""
    first = F.min_by(F.struct(*HEAD), "slug").alias("_h")
    return facts.groupBy("codigo").agg(first, *positive_stats()).select("codigo", "_h.*", *STATS, "conDato")


def item_document(facts: DataFrame) -> DataFrame:
    """One nested row per item, its regions sorted by slug.

    The array holds one element per region, so it is bounded by that dimension.
    """
    region = F.struct(
        F.col("slug").alias("_k"),
        F.struct(
            F.col("regionCodigo").alias("codigo"),
            F.col("regionCodigoDane").alias("codigoDane"),
            "departamento",
            "provincia",
            "slug",
        ).alias("region"),
        F.struct(*COMPONENTES).alias("totales"),
        "costoDirecto",
    )
    columns = (*HEAD, "vigencia", "articulo", "notaFuente")
    grouped = facts.groupBy("codigo").agg(
        F.min_by(F.struct(*columns), "slug").alias("_h"),
        F.struct(*positive_stats()).alias("_s"),
        F.array_sort(F.collect_list(region)).alias("_r"),
    )
    return grouped.select(
        "codigo",
        "_h.*",
        F.struct(*(F.col(f"_s.{c}") for c in STATS)).alias("agregados"),
        F.col("_s.conDato").alias("provinciasConDato"),
        F.transform("_r", lambda r: F.struct(r["region"].alias("region"), r["totales"].alias("totales"), r["costoDirecto"].alias("costoDirecto"))).alias("regiones"),
    )


def province_summary(facts: DataFrame) -> DataFrame:
    """Summary of each region over its items."""
    region = ["slug", "regionCodigo", "regionCodigoDane", "departamento", "provincia"]
    stats = agg_positive(facts, ["slug"])
    head = facts.groupBy("slug").agg(F.min(F.struct(*region[1:], "vigencia")).alias("_h"))
    return head.join(stats, "slug").select("slug", "_h.*", *STATS, F.col("conDato").alias("itemsConDato"))


def province_document(facts: DataFrame) -> DataFrame:
    """Province summary with its items in natural code order.

    Items are gathered per three-digit chapter, so no task ever holds more than
    one chapter of one province; ``capitulos`` of a document is read in order.
    """
    item = F.struct(
        natural_key(F.col("codigo")).alias("_k"),
        "codigo",
        title(F.col("descripcion")).alias("titulo"),
        "unidad",
        "capitulo",
        "costoDirecto",
    )
    items = (
        facts.groupBy("slug", "capitulo")
        .agg(F.array_sort(F.collect_list(item)).alias("_i"))
        .select(
            "slug",
            F.col("capitulo").alias("parte"),
            F.transform(
                "_i",
                lambda i: F.struct(*(i[c].alias(c) for c in ("codigo", "titulo", "unidad", "capitulo", "costoDirecto"))),
            ).alias("items"),
        )
    )
    return province_summary(facts).join(items, "slug")


def province_items(facts: DataFrame) -> DataFrame:
    """The items of every province with their place (``posicion``) in natural code order."""
    chapter = F.coalesce(F.split_part(F.col("codigo"), F.lit("."), F.lit(1)).try_cast("long"), F.lit(-1))
    placed = positions(facts, ["slug"], [natural_key(F.col("codigo"))], chapter, name="posicion")
    return placed.select("slug", "posicion", "codigo", title(F.col("descripcion")).alias("titulo"), "unidad", "capitulo", "costoDirecto")


def stats_counts(facts: DataFrame, n_lines: Column, n_supplies: Column, n_unresolved: Column) -> DataFrame:
    """Row counts and distinct keys, in one pass over the facts."""
    return facts.agg(
        F.count_distinct("codigo").alias("items"),
        F.count_distinct("slug").alias("provincias"),
        F.count_distinct("regionCodigoDane").alias("departamentos"),
        F.count(F.lit(1)).alias("apus"),
    ).withColumns({"lineas": n_lines, "insumos": n_supplies, "lineasSinResolver": n_unresolved})


def items_per_chapter(facts: DataFrame) -> DataFrame:
    return facts.select("capitulo", "codigo").distinct().groupBy("capitulo").agg(F.count(F.lit(1)).alias("items"))


def file_order() -> Column:
    """Order in which rows reach the build: file, then item."""
    return F.struct(F.col("archivo"), natural_key(F.col("codigo")))


def items_per_constructive_chapter(facts: DataFrame) -> DataFrame:
    """Only rows with both number and name; the first name seen stands."""
    named = facts.where(F.col("capituloNumero").isNotNull() & F.col("capituloNombre").isNotNull())
    per_item = named.groupBy("capituloNumero", "codigo").agg(
        F.min(F.struct(file_order().alias("k"), F.col("capituloNombre").alias("nombre"))).alias("h")
    )
    return per_item.groupBy(F.col("capituloNumero").alias("numero")).agg(
        F.min("h")["nombre"].alias("nombre"), F.count(F.lit(1)).alias("items")
    )


def provinces_per_department(facts: DataFrame) -> DataFrame:
    per_region = facts.groupBy("regionCodigoDane", "slug").agg(
        F.min(F.struct(file_order().alias("k"), "departamento")).alias("h")
    )
    return (
        per_region.groupBy(F.col("regionCodigoDane").alias("codigoDane"))
        .agg(F.min("h")["departamento"].alias("crudo"), F.count(F.lit(1)).alias("provincias"))
        .select("codigoDane", F.coalesce(department_name(F.col("codigoDane")), F.col("crudo")).alias("nombre"), "provincias")
    )


def extreme_provinces(summary: DataFrame) -> DataFrame:
    """Cheapest and dearest region by (median, slug)."""
    key = F.struct("mediana", "slug")
    row = F.struct("slug", "departamento", "provincia", F.col("mediana").alias("medianaCostoDirecto"))
    ends = summary.agg(F.min_by(row, key).alias("barata"), F.max_by(row, key).alias("cara"))
    both = F.array(
        F.struct(F.lit("provinciaMasBarata").alias("tipo"), F.col("barata").alias("p")),
        F.struct(F.lit("provinciaMasCara").alias("tipo"), F.col("cara").alias("p")),
    )
    return ends.select(F.explode(both).alias("x")).select("x.tipo", "x.p.*")


def composition_by_chapter(facts: DataFrame) -> DataFrame:
    """Mean component share per constructive chapter, each fact weighing the
    same.  A fact counts for the chapter of its item's first region.  Empty
    chapters are dropped."""
    head = chapter_heads(facts)
    first = F.min_by(F.struct("capituloNumero", "capitulo"), "slug").alias("_h")
    numero = chapter_number(F.col("_h.capituloNumero"), F.col("_h.capitulo"))
    items = facts.groupBy("codigo").agg(first).select("codigo", numero.alias("numero"))
    priced = facts.where(F.col("costoDirecto") > 0).select("codigo", "costoDirecto", *COMPONENTES).join(items, "codigo")
    grouped = priced.groupBy("numero").agg(
        F.count(F.lit(1)).alias("apus"), *(mean_ratio(F.col(c) / F.col("costoDirecto")).alias(c) for c in COMPONENTES)
    )
    return grouped.join(head, "numero").select("numero", "nombre", "apus", *COMPONENTES)


def chapter_heads(facts: DataFrame) -> DataFrame:
    """Name of each constructive chapter: that of its first item in code order
    (with the attributes of the item's first region)."""
    numero = chapter_number(F.col("capituloNumero"), F.col("capitulo"))
    key = F.struct(natural_key(F.col("codigo")), F.col("slug"))
    return facts.groupBy(numero.alias("numero")).agg(
        F.min_by(F.struct(chapter_name(F.col("capituloNombre"), numero).alias("nombre")), key)["nombre"].alias("nombre")
    )


def relative_level(facts: DataFrame, catalog_rows: DataFrame, chapter_map: DataFrame) -> DataFrame:
    """Median of cost / national item median per department and chapter.

    A department without any cell keeps one row with null chapter.
    """
    from preciario.operators.joins import join_chapter_map, join_national_median

    ratios = (
        join_chapter_map(join_national_median(facts, catalog_rows), chapter_map)
        .select("regionCodigoDane", "numero", (F.col("costoDirecto") / F.col("medianaNacional")).alias("v"))
    )
    cells = group_median(ratios, ["regionCodigoDane", "numero"], "v", "razon", "apus")
    departments = facts.groupBy("regionCodigoDane").agg(F.max_by("departamento", "slug").alias("departamento"))
    return departments.join(cells, "regionCodigoDane", "left").select(
        F.col("regionCodigoDane").alias("codigoDane"), "departamento", "numero", "razon", F.coalesce("apus", F.lit(0)).alias("apus")
    )


def compare_chapters(facts: DataFrame, catalog_rows: DataFrame, chapter_map: DataFrame) -> DataFrame:
    """Province against national median per chapter, for every province.

    The national side is restricted to the items priced in the province and
    falls back to the whole catalog chapter, zeros included, when none is.
    """
    from preciario.operators.joins import join_chapter_map

    medians = catalog_rows.select("codigo", F.col("mediana").alias("med"))
    rows = join_chapter_map(facts.select("slug", "codigo", "capitulo", "costoDirecto"), chapter_map).join(medians, "codigo", "left")
    counts = rows.groupBy("slug", "numero").agg(
        F.max("nombre").alias("nombre"), F.count_if(F.col("costoDirecto") > 0).alias("conDato"), F.count(F.lit(1)).alias("total")
    )
    priced = rows.where(F.col("costoDirecto") > 0)
    keys = ["slug", "numero"]
    local = group_median(priced, keys, "costoDirecto", "medianaProvincia").drop("n")
    comparable = group_median(priced, keys, "med", "restringida").drop("n")
    whole = group_median(
        join_chapter_map(catalog_rows.select("codigo", "capitulo", "mediana"), chapter_map), ["numero"], "mediana", "entera"
    ).drop("n")
    return (
        counts.join(local, keys, "left")
        .join(comparable, keys, "left")
        .join(whole, "numero", "left")
        .select(
            *keys,
            "nombre",
            _zero(F.col("medianaProvincia")).alias("medianaProvincia"),
            F.coalesce("restringida", "entera", F.lit(0.0)).alias("medianaNacional"),
            "conDato",
            "total",
        )
    )


def dept_median_of_medians(summary: DataFrame) -> DataFrame:
    """Median of the province medians per department.  Zeros are kept here."""
    return group_median(summary, ["regionCodigoDane"], "mediana", "medianaDepartamento", "provincias")


def dept_mean_for_item(facts: DataFrame) -> DataFrame:
    """Mean positive cost per item and department; empty departments drop out."""
    return (
        facts.where(F.col("costoDirecto") > 0)
        .groupBy("codigo", "regionCodigoDane")
        .agg((sum_money(F.col("costoDirecto")) / F.count(F.lit(1))).alias("promedio"), F.count(F.lit(1)).alias("n"))
    )


def group_by_department(roster: DataFrame) -> DataFrame:
    """Provinces nested per department, in the order of the Spanish alphabet."""
    shown = ("provincia", "slug", "mediana", "itemsConDato")
    entry = F.struct(F.collate(F.col("provincia"), "es").alias("_k"), *shown)
    grouped = roster.groupBy("regionCodigoDane").agg(
        F.min("departamento").alias("departamento"), F.array_sort(F.collect_list(entry)).alias("_p")
    )
    plain = F.transform("_p", lambda p: F.struct(*(p[c].alias(c) for c in shown)))
    return grouped.select("regionCodigoDane", "departamento", plain.alias("provincias"))


def group_by_chapter(items: DataFrame) -> DataFrame:
    """Items nested per constructive chapter and code prefix, code order kept.

    ``items`` are catalog rows with their constructive chapter.  Gathering by
    code prefix as well keeps each array to one three-digit chapter.
    """
    entry = F.struct(natural_key(F.col("codigo")).alias("_k"), "codigo")
    return (
        items.groupBy("capituloNumero", "capitulo")
        .agg(F.array_sort(F.collect_list(entry)).alias("_i"))
        .select("capituloNumero", "capitulo", F.transform("_i", lambda i: i["codigo"]).alias("codigos"))
    )


def distinct_chapters(items: DataFrame) -> DataFrame:
    """Chapters present, named by their first item."""
    return items.groupBy("capituloNumero").agg(
        F.min_by("capituloNombre", natural_key(F.col("codigo"))).alias("capituloNombre")
    )


def _components(lines: DataFrame) -> DataFrame:
    """Component subtotals, totals and the place of each present component, by one aggregate of the lines."""
    sums = [round_money(sum_money(F.when(F.col("componente") == c, F.col("subtotal")))).alias(f"_s{i}") for i, c in enumerate(COMPONENTES)]
    counts = [F.count_if(F.col("componente") == c).alias(f"_n{i}") for i, c in enumerate(COMPONENTES)]
    order = range(len(COMPONENTES))
    parts = F.array(*(F.struct(F.lit(c).alias("componente"), F.col(f"_s{i}").alias("subtotal"), F.col(f"_n{i}").alias("lineas")) for i, c in enumerate(COMPONENTES)))
    units = reduce(lambda a, b: a + b, (F.coalesce(exact_units(F.col(f"_s{i}")), F.lit(0)) for i in order))
    some = F.coalesce(*(F.col(f"_s{i}") for i in order)).isNotNull()
    wide = lines.groupBy("codigo", "slug").agg(*sums, *counts)
    return wide.select(
        "codigo",
        "slug",
        F.when(some, round_money(from_units(units))).alias("total"),
        reduce(lambda a, b: a + b, (F.col(f"_n{i}") for i in order)).alias("lineasTotal"),
        F.posexplode(F.filter(parts, lambda x: x["lineas"] > 0)).alias("_p", "_x"),
    ).select("codigo", "slug", "_x.*", "total", "lineasTotal", (F.col("_p") + 1).alias("posicion"))


def breakdown(lines: DataFrame) -> DataFrame:
    """Component subtotals of each item and region; the total adds the already
    rounded subtotals."""
    return _components(lines).drop("posicion")


def breakdown_lines(lines: DataFrame, unnumbered: DataFrame | None = None) -> DataFrame:
    """The whole breakdown of each item and region, one row per line: components
    in the order of the printed form, lines by ``orden``, with the component's
    subtotal and the total.  ``posicion`` numbers the components that are there.
    ``unnumbered`` are the same lines before ``orden`` was given, which sums don't need."""
    placed = _components(lines if unnumbered is None else unnumbered).withColumnRenamed("subtotal", "subtotalComponente").drop("lineas")
    return lines.select(*COLUMNAS_DESGLOSE).join(placed, ["codigo", "slug", "componente"])


def unresolved_by_item(unresolved: DataFrame) -> DataFrame:
    return unresolved.groupBy("hoja").agg(F.count(F.lit(1)).alias("n"))


def national_median_of_provinces(summary: DataFrame) -> DataFrame:
    """Median of the positive province medians; 0 when there is none."""
    found = group_median(summary.where(F.col("mediana") > 0), [], "mediana", "medianaNacional", "provincias")
    return found.select(_zero(F.col("medianaNacional")).alias("medianaNacional"), F.coalesce("provincias", F.lit(0)).alias("provincias"))


def apus_with_data(composition: DataFrame) -> DataFrame:
    return composition.agg(F.coalesce(F.sum("apus"), F.lit(0)).alias("apusConDato"))


def stats_document(facts: DataFrame, n_lines: Column, n_supplies: Column, n_unresolved: Column) -> DataFrame:
    """The statistics as one row: counts, national summary, chapters,
    constructive chapters, departments and the two extreme provinces.  Its arrays
    hold a row per chapter or department, bounded by those dimensions."""
    summary = province_summary(facts)
    whole = agg_positive(facts, []).select(F.struct(*STATS).alias("costoDirecto"))

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))

    counts = stats_counts(facts, n_lines, n_supplies, n_unresolved)
    ends = extreme_provinces(summary)
    place = F.struct("slug", "departamento", "provincia", "medianaCostoDirecto")
    notable = ends.agg(*(F.max(F.when(F.col("tipo") == t, place)).alias(t) for t in ("provinciaMasCara", "provinciaMasBarata")))
    parts = [
        counts.select(F.struct(*counts.columns).alias("conteos")),
        whole,
        gathered(items_per_chapter(facts).select("capitulo", "items"), "capitulos"),
        gathered(items_per_constructive_chapter(facts).select("numero", "nombre", "items"), "capitulosInvias"),
        gathered(provinces_per_department(facts).select("codigoDane", "nombre", "provincias"), "departamentos"),
        notable.select(F.struct("provinciaMasCara", "provinciaMasBarata").alias("notables")),
    ]
    # each part is one row
    keyed = [part.withColumn("_k", F.lit(1)) for part in parts]
    return reduce(lambda a, b: a.join(b, "_k"), keyed).drop("_k")


def output_sizes(files: DataFrame) -> DataFrame:
    """Number of files, total bytes, and the largest one."""
    return files.agg(
        F.count(F.lit(1)).alias("archivos"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("mayor"),
        F.max_by("filename", F.struct("bytes", "filename")).alias("archivoMayor"),
    )
