"""Aggregations, rankings, bins and sorts over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from preciario.operators import aggregates as A
from preciario.operators import clean, extract, joins as J, ranking as R, sorting as S
from preciario.plans.oracle import exact, med, money, natural, sql, stats
from preciario.plans.registry import query
from preciario.sources import tables as T
from preciario.sources.layout import SECCIONES_ANCHAS

CAT_COLUMNS = (
    "codigo, descripcion, unidad, unidadCruda, capitulo, capituloNumero, capituloNombre, clasificacion, min, max, mediana, promedio, conDato"
)
NUMERO = "coalesce(capituloNumero, CAST(left(capitulo,1) AS INTEGER))"


@query("agg_positive", sql(f"SELECT capitulo, {stats()} FROM apus GROUP BY capitulo", "apus"))
def agg_positive(spark, sf):
    return A.agg_positive(T.facts(spark, sf), ["capitulo"])


@query("catalog", sql(f"SELECT {CAT_COLUMNS} FROM cat", "cat"))
def catalog(spark, sf):
    return A.catalog(T.facts(spark, sf))


@query(
    "item_document",
    sql(
        "SELECT c.codigo, c.descripcion, c.min, c.max, c.mediana, c.promedio, c.conDato AS provinciasConDato, "
        "CAST(row_number() OVER (PARTITION BY a.codigo ORDER BY a.slug) AS INTEGER) AS posicion, a.regionCodigo, a.slug, a.equipo, a.materiales, a.transporte, a.manoDeObra, a.costoDirecto "
        "FROM cat c JOIN apus a USING (codigo)",
        "cat",
    ),
)
def item_document(spark, sf):
    docs = A.item_document(T.facts(spark, sf))
    flat = docs.select("codigo", "descripcion", "agregados.*", "provinciasConDato", F.posexplode("regiones").alias("pos", "r"))
    return flat.select(
        "codigo", "descripcion", "min", "max", "mediana", "promedio", "provinciasConDato", (F.col("pos") + 1).alias("posicion"),
        F.col("r.region.codigo").alias("regionCodigo"), "r.region.slug", "r.totales.*", "r.costoDirecto",
    )


@query(
    "province_summary",
    sql(
        "SELECT p.slug, p.regionCodigo, p.departamento, p.min, p.max, p.mediana, p.promedio, p.conDato AS itemsConDato, a.capitulo AS parte, "
        f"CAST(row_number() OVER (PARTITION BY a.slug, a.capitulo ORDER BY {natural('a.codigo')}) AS INTEGER) AS posicion, a.codigo, "
        "string_split(a.descripcion, chr(10))[1] AS titulo, a.unidad, a.costoDirecto FROM prov p JOIN apus a USING (slug)",
        "prov",
    ),
)
def province_summary(spark, sf):
    docs = A.province_document(T.facts(spark, sf))
    head = ["slug", "regionCodigo", "departamento", "min", "max", "mediana", "promedio", "itemsConDato", "parte"]
    return docs.select(*head, F.posexplode("items").alias("pos", "i")).select(
        *head, (F.col("pos") + 1).alias("posicion"), "i.codigo", "i.titulo", "i.unidad", "i.costoDirecto"
    )


@query(
    "stats_counts",
    sql(
        "SELECT count(DISTINCT codigo) AS items, count(DISTINCT slug) AS provincias, count(DISTINCT regionCodigoDane) AS departamentos, count(*) AS apus, "
        "(SELECT count(*) FROM lineas) AS lineas, (SELECT count(*) FROM insumos) AS insumos, "
        "(SELECT count(*) FROM filas WHERE l_tax>0 AND NOT l_discount>0) AS lineasSinResolver FROM apus",
        "apus", "insumos", "filas",
    ),
)
def stats_counts(spark, sf):
    def count(df):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    unresolved = extract.unresolved_lines(T.cells(spark, sf), SECCIONES_ANCHAS)
    return A.stats_counts(T.facts(spark, sf), count(T.priced_lines(spark, sf)), count(T.supplies(spark, sf)), count(unresolved))


@query("stats_global", sql(f"SELECT {stats()} FROM apus", "apus"))
def stats_global(spark, sf):
    return A.agg_positive(T.facts(spark, sf), [])


@query("items_per_chapter", sql("SELECT capitulo, count(DISTINCT codigo) AS items FROM apus GROUP BY capitulo", "apus"))
def items_per_chapter(spark, sf):
    return A.items_per_chapter(T.facts(spark, sf))


@query(
    "items_per_constructive_chapter",
    sql(
        "SELECT capituloNumero AS numero, (list(capituloNombre ORDER BY archivo, " + natural("codigo") + "))[1] AS nombre, "
        "count(DISTINCT codigo) AS items FROM apus WHERE capituloNumero IS NOT NULL AND capituloNombre IS NOT NULL GROUP BY capituloNumero",
        "apus",
    ),
)
def items_per_constructive_chapter(spark, sf):
    return A.items_per_constructive_chapter(T.facts(spark, sf))


DEPARTMENT = (
    "CASE regionCodigoDane WHEN '05' THEN 'Antioquia' WHEN '08' THEN 'Atlántico' WHEN '11' THEN 'Bogotá D.C.' WHEN '17' THEN 'Caldas' END"
)


@query(
    "provinces_per_department",
    sql(
        f"SELECT regionCodigoDane AS codigoDane, coalesce({DEPARTMENT}, min(departamento)) AS nombre, count(DISTINCT slug) AS provincias "
        "FROM apus GROUP BY regionCodigoDane",
        "apus",
    ),
)
def provinces_per_department(spark, sf):
    return A.provinces_per_department(T.facts(spark, sf))


@query(
    "extreme_provinces",
    sql(
        "(SELECT 'provinciaMasBarata' AS tipo, slug, departamento, provincia, mediana AS medianaCostoDirecto FROM prov ORDER BY mediana, slug LIMIT 1) "
        "UNION ALL (SELECT 'provinciaMasCara', slug, departamento, provincia, mediana FROM prov ORDER BY mediana DESC, slug DESC LIMIT 1)",
        "prov",
    ),
)
def extreme_provinces(spark, sf):
    return A.extreme_provinces(A.province_summary(T.facts(spark, sf)))


def _share(c: str) -> str:
    return f"CAST(sum(CAST(floor({c}/nullif(costoDirecto,0)*1e12+0.5) AS BIGINT)) FILTER (WHERE costoDirecto>0) AS DOUBLE)/count(*) FILTER (WHERE costoDirecto>0)/1e12 AS {c}"


COMPOSITION = (
    f"SELECT {NUMERO} AS numero, (list(coalesce(capituloNombre,'Capítulo '||left(capitulo,1)) ORDER BY {natural('codigo')}, slug))[1] AS nombre, "
    "count(*) FILTER (WHERE costoDirecto>0) AS apus, " + ", ".join(_share(c) for c in ("equipo", "materiales", "transporte", "manoDeObra")) + " FROM apus GROUP BY 1"
)


@query("composition_by_chapter", sql(COMPOSITION, "apus"))
def composition_by_chapter(spark, sf):
    return A.composition_by_chapter(T.facts(spark, sf))


@query("apus_with_data", sql("SELECT count(*) FILTER (WHERE costoDirecto>0) AS apusConDato FROM apus", "apus"))
def apus_with_data(spark, sf):
    return A.apus_with_data(A.composition_by_chapter(T.facts(spark, sf)))


LEVEL = (
    f"SELECT regionCodigoDane AS codigoDane, max(departamento) AS departamento, m.numero, {med('costoDirecto/mediana')} AS razon, count(*) AS apus "
    "FROM apus JOIN (SELECT codigo, mediana FROM cat WHERE mediana>0) USING (codigo) JOIN cmap m USING (capitulo) WHERE costoDirecto>0 "
    "GROUP BY regionCodigoDane, m.numero"
)


@query("relative_level", sql(LEVEL, "cmap"))
def relative_level(spark, sf):
    facts = T.facts(spark, sf)
    cat = A.catalog(facts)
    return A.relative_level(facts, cat, J.chapter_map(cat))


COMPARE = (
    f"SELECT slug, numero, nombre, coalesce(local,0) AS medianaProvincia, coalesce(rest, entera, 0) AS medianaNacional, conDato, total FROM ("
    f"SELECT slug, m.numero, max(m.nombre) AS nombre, {med('costoDirecto', 'costoDirecto>0')} AS local, {med('mediana', 'costoDirecto>0')} AS rest, "
    "count(*) FILTER (WHERE costoDirecto>0) AS conDato, count(*) AS total FROM apus JOIN (SELECT codigo, mediana FROM cat) USING (codigo) "
    "JOIN cmap m USING (capitulo) GROUP BY slug, m.numero) "
    f"JOIN (SELECT m.numero, {med('mediana')} AS entera FROM cat JOIN cmap m USING (capitulo) GROUP BY m.numero) USING (numero)"
)


@query("compare_chapters", sql(COMPARE, "cmap"))
def compare_chapters(spark, sf):
    facts = T.facts(spark, sf)
    cat = A.catalog(facts)
    return A.compare_chapters(facts, cat, J.chapter_map(cat))


@query(
    "dept_median_of_medians",
    sql(f"SELECT regionCodigoDane, {med('mediana')} AS medianaDepartamento, count(*) AS provincias FROM prov GROUP BY regionCodigoDane", "prov"),
)
def dept_median_of_medians(spark, sf):
    return A.dept_median_of_medians(A.province_summary(T.facts(spark, sf)))


@query(
    "dept_mean_for_item",
    sql(
        f"SELECT codigo, regionCodigoDane, {exact('costoDirecto')}/count(*) AS promedio, count(*) AS n FROM apus WHERE costoDirecto>0 "
        "GROUP BY codigo, regionCodigoDane",
        "apus",
    ),
)
def dept_mean_for_item(spark, sf):
    return A.dept_mean_for_item(T.facts(spark, sf))


@query(
    "province_roster",
    sql("SELECT regionCodigo, regionCodigoDane, departamento, provincia, slug, mediana, conDato AS itemsConDato FROM prov", "prov"),
)
def province_roster(spark, sf):
    return S.province_roster(A.province_summary(T.facts(spark, sf)))


@query(
    "group_by_department",
    sql(
        "SELECT regionCodigoDane, departamento, CAST(row_number() OVER (PARTITION BY regionCodigoDane ORDER BY provincia) AS INTEGER) AS posicion, "
        "provincia, slug, mediana, conDato AS itemsConDato FROM prov",
        "prov",
    ),
)
def group_by_department(spark, sf):
    groups = A.group_by_department(A.province_summary(T.facts(spark, sf)))
    return groups.select("regionCodigoDane", "departamento", F.posexplode("provincias").alias("pos", "p")).select(
        "regionCodigoDane", "departamento", (F.col("pos") + 1).alias("posicion"), "p.*"
    )


@query(
    "group_by_chapter",
    sql(
        f"SELECT {NUMERO} AS capituloNumero, capitulo, CAST(row_number() OVER (PARTITION BY {NUMERO}, capitulo ORDER BY {natural('codigo')}) AS INTEGER) AS posicion, codigo FROM cat",
        "cat",
    ),
)
def group_by_chapter(spark, sf):
    groups = A.group_by_chapter(clean.chapters(A.catalog(T.facts(spark, sf))))
    return groups.select("capituloNumero", "capitulo", F.posexplode("codigos").alias("pos", "codigo")).select(
        "capituloNumero", "capitulo", (F.col("pos") + 1).alias("posicion"), "codigo"
    )


@query(
    "distinct_chapters",
    sql(
        f"SELECT {NUMERO} AS capituloNumero, (list(coalesce(capituloNombre,'Capítulo '||left(capitulo,1)) ORDER BY {natural('codigo')}))[1] AS capituloNombre FROM cat GROUP BY 1",
        "cat",
    ),
)
def distinct_chapters(spark, sf):
    return A.distinct_chapters(clean.chapters(A.catalog(T.facts(spark, sf))))


BREAKDOWN = (
    f"SELECT *, {money('CAST(sum(CAST(subtotal AS DECIMAL(20,4))) OVER (PARTITION BY codigo, slug) AS DOUBLE)')} AS total, "
    "CAST(sum(lineas) OVER (PARTITION BY codigo, slug) AS BIGINT) AS lineasTotal FROM "
    f"(SELECT codigo, slug, componente, {money(exact('subtotal'))} AS subtotal, count(*) AS lineas FROM lineas GROUP BY codigo, slug, componente)"
)


@query(
    "breakdown",
    sql(
        "SELECT o.codigo, o.slug, o.orden, o.componente, o.codigoInsumo, o.descripcion, o.unidad, o.unidadCruda, o.cantidad, o.precioUnitario, CAST(o.subtotal AS DOUBLE) AS subtotal, "
        "NULL::DOUBLE AS porcentaje, NULL::DOUBLE AS base, o.distancia, o.jornal, o.factorPrestacional, b.subtotal AS subtotalComponente, b.total, b.lineasTotal, "
        "CAST(b.posicion AS INTEGER) AS posicion FROM ordenadas o JOIN (SELECT *, row_number() OVER (PARTITION BY codigo, slug ORDER BY "
        f"list_position(['equipo','materiales','transporte','manoDeObra'], componente)) AS posicion FROM ({BREAKDOWN})) b "
        "ON o.codigo=b.codigo AND o.slug=b.slug AND o.componente=b.componente",
        "ordenadas",
    ),
)
def breakdown(spark, sf):
    lines = T.lines(spark, sf)
    return A.breakdown_lines(T.with_order(lines), lines)


@query("unresolved_by_item", sql("SELECT hoja, count(*) AS n FROM filas WHERE l_tax>0 AND NOT l_discount>0 GROUP BY hoja", "filas"))
def unresolved_by_item(spark, sf):
    return A.unresolved_by_item(extract.unresolved_lines(T.cells(spark, sf), SECCIONES_ANCHAS))


@query(
    "national_median_of_provinces",
    sql(f"SELECT coalesce({med('mediana', 'mediana>0')},0) AS medianaNacional, count(*) FILTER (WHERE mediana>0) AS provincias FROM prov", "prov"),
)
def national_median_of_provinces(spark, sf):
    return A.national_median_of_provinces(A.province_summary(T.facts(spark, sf)))


# ---------------------------------------------------------------- rankings


@query(
    "rank_province",
    sql(
        "SELECT slug, mediana, row_number() OVER (ORDER BY mediana, slug) AS puesto, count(*) OVER () AS total FROM prov WHERE mediana>0",
        "prov",
    ),
)
def rank_province(spark, sf):
    return R.rank_province(A.province_summary(T.facts(spark, sf)))


TOP = (
    "t AS (SELECT *, CAST(row_number() OVER (PARTITION BY codigo, slug, componente ORDER BY subtotal DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS puesto "
    "FROM lineas WHERE subtotal>0)"
)
TOP_OTHER = (
    "SELECT codigo, slug, componente, puesto, codigoInsumo, CAST(1 AS BIGINT) AS n, CAST(subtotal AS DOUBLE) AS valor FROM t WHERE puesto<=3 "
    "UNION ALL SELECT codigo, slug, componente, 4, NULL, count(*), CAST(sum(subtotal) AS DOUBLE) FROM t WHERE puesto>3 GROUP BY codigo, slug, componente"
)


def _top(body: str) -> str:
    return sql("SELECT 1", "lineas").removesuffix(" SELECT 1") + ", " + TOP + " " + body


@query("topk_lines_with_other", _top(TOP_OTHER))
def topk_lines_with_other(spark, sf):
    return R.topk_lines_with_other(T.lines(spark, sf))


@query(
    "flow_edges",
    _top(
        "SELECT codigo, slug, 'Costo directo' AS origen, componente AS destino, 0 AS puesto, CAST(sum(subtotal) AS DOUBLE) AS valor FROM t GROUP BY codigo, slug, componente "
        "UNION ALL SELECT codigo, slug, componente, CASE WHEN puesto>3 THEN 'Otras líneas ('||CAST(n AS VARCHAR)||')' ELSE codigoInsumo END, puesto, valor FROM ("
        + TOP_OTHER
        + ")"
    ),
)
def flow_edges(spark, sf):
    return R.flow_edges(T.lines(spark, sf))


FEATURED = (
    "r AS (SELECT codigo, capitulo, mediana, " + NUMERO + " AS numero FROM cat WHERE mediana>0), "
    f"v AS (SELECT *, row_number() OVER (PARTITION BY numero ORDER BY mediana DESC, {natural('codigo')}) AS turno FROM r), "
    f"o AS (SELECT codigo, mediana, row_number() OVER (ORDER BY CASE WHEN capitulo='648' THEN 0 ELSE 1 END, CASE WHEN capitulo='648' THEN 0 ELSE turno END, "
    f"CASE WHEN capitulo='648' THEN 0 ELSE numero END, {natural('codigo')}) AS posicion FROM v)"
)


def _featured(body: str) -> str:
    return sql("SELECT 1", "cat").removesuffix(" SELECT 1") + ", " + FEATURED + " " + body


#: Chapter of the driver tables that plays the part of the reference family.
FAMILY = "648"


@query("featured_round_robin", _featured("SELECT CAST(posicion AS INTEGER) AS posicion, codigo, mediana FROM o WHERE posicion<=60"))
def featured_round_robin(spark, sf):
    return R.featured_round_robin(A.catalog(T.facts(spark, sf)), limit=60, chapter=FAMILY)


@query("featured_family", sql("SELECT codigo, mediana FROM cat WHERE capitulo='648' AND mediana>0", "cat"))
def featured_family(spark, sf):
    return R.featured_family(A.catalog(T.facts(spark, sf)), FAMILY).select("codigo", "mediana")


@query(
    "head_row",
    sql("SELECT codigo, descripcion, unidad, unidadCruda, capitulo, capituloNumero, capituloNombre, clasificacion FROM cabezas", "cabezas"),
)
def head_row(spark, sf):
    return A.head_row(T.facts(spark, sf), ["codigo"], F.col("slug"))


CURVE = (
    "SELECT codigo, slug, costoDirecto AS valor, CAST(row_number() OVER (PARTITION BY codigo ORDER BY costoDirecto, slug) AS INTEGER) AS puesto, "
    "count(*) OVER (PARTITION BY codigo) AS total FROM apus WHERE costoDirecto>0"
)


@query(
    "price_curve",
    sql(
        f"SELECT c.*, m.mediana, puesto=1 AS primera, puesto=total AS ultima FROM ({CURVE}) c JOIN (SELECT codigo, {med('costoDirecto', 'costoDirecto>0')} AS mediana FROM apus GROUP BY codigo) m USING (codigo)",
        "apus",
    ),
)
def price_curve(spark, sf):
    return R.price_curve(T.facts(spark, sf))


@query("median_region_pick", sql(f"SELECT codigo, slug, valor FROM ({CURVE}) WHERE puesto = total//2 + 1", "apus"))
def median_region_pick(spark, sf):
    return R.median_region_pick(T.facts(spark, sf))


@query(
    "share_of_total",
    sql(
        "SELECT codigo, slug, "
        + ", ".join(f"CASE WHEN costoDirecto<>0 THEN {c}/costoDirecto END AS peso_{c}" for c in ("equipo", "materiales", "transporte", "manoDeObra"))
        + " FROM apus",
        "apus",
    ),
)
def share_of_total(spark, sf):
    shares = R.share_of_total(T.facts(spark, sf))
    return shares.select("codigo", "slug", *(c for c in shares.columns if c.startswith("peso_")))


@query(
    "components_long",
    sql(
        "SELECT codigo, slug, componente, valor FROM (SELECT codigo, slug, equipo, materiales, transporte, manoDeObra FROM apus) "
        "UNPIVOT (valor FOR componente IN (equipo, materiales, transporte, manoDeObra)) WHERE valor>0",
        "apus",
    ),
)
def components_long(spark, sf):
    return R.components_long(T.facts(spark, sf), ["codigo", "slug"])


@query(
    "bin_equal_width",
    sql(
        "SELECT codigo, regionCodigoDane, valor, CASE WHEN hi<=lo THEN 5 ELSE CAST(least(5, floor((valor-lo)/(hi-lo)*6)) AS INTEGER) END AS tramo FROM ("
        "SELECT *, min(valor) OVER (PARTITION BY codigo) AS lo, max(valor) OVER (PARTITION BY codigo) AS hi FROM ("
        f"SELECT codigo, regionCodigoDane, {exact('costoDirecto')}/count(*) AS valor FROM apus WHERE costoDirecto>0 GROUP BY codigo, regionCodigoDane))",
        "apus",
    ),
)
def bin_equal_width(spark, sf):
    means = A.dept_mean_for_item(T.facts(spark, sf)).select("codigo", "regionCodigoDane", F.col("promedio").alias("valor"))
    return R.bin_equal_width(means, "valor", keys=["codigo"])


@query(
    "bin_thresholds",
    sql(
        "SELECT codigoDane, numero, razon, CASE WHEN razon<=0 THEN NULL WHEN razon<=0.9 THEN 0 WHEN razon<=0.97 THEN 1 WHEN razon<=1.03 THEN 2 "
        f"WHEN razon<=1.1 THEN 3 WHEN razon<=1.5 THEN 4 ELSE 5 END AS tramo FROM ({LEVEL})",
        "cmap",
    ),
)
def bin_thresholds(spark, sf):
    level = relative_level(spark, sf).select("codigoDane", "numero", "razon")
    return R.bin_thresholds(level, "razon")


@query(
    "contiguous_groups",
    sql(
        "SELECT codigo, slug, departamento, CAST(dense_rank() OVER (PARTITION BY codigo ORDER BY departamento) AS BIGINT) AS grupo FROM apus",
        "apus",
    ),
)
def contiguous_groups(spark, sf):
    rows = T.facts(spark, sf).select("codigo", "slug", "departamento")
    return R.contiguous_groups(rows, ["codigo"], ["departamento", "slug"], "departamento")


@query(
    "chunk_ordinal",
    sql(
        f"SELECT codigo, slug, o AS ordinal, o//1000 AS parte FROM (SELECT codigo, slug, row_number() OVER (ORDER BY {natural('codigo')}, slug)-1 AS o FROM apus)",
        "apus",
    ),
)
def chunk_ordinal(spark, sf):
    return R.chunk_ordinal(T.facts(spark, sf).select("codigo", "slug"), size=1000)


# ---------------------------------------------------------------- sorts


@query(
    "sort_natural_code",
    sql(f"SELECT codigo, slug, row_number() OVER (ORDER BY {natural('codigo')}, slug)-1 AS ordinal FROM apus", "apus"),
)
def sort_natural_code(spark, sf):
    return S.sort_natural_code(R.global_ordinal(T.facts(spark, sf).select("codigo", "slug")), "slug")


@query("sort_locale", sql("SELECT departamento, provincia, slug, mediana FROM prov", "prov"))
def sort_locale(spark, sf):
    rows = A.province_summary(T.facts(spark, sf)).select("departamento", "provincia", "slug", "mediana")
    return S.sort_locale(rows, "departamento", "provincia")


@query(
    "sort_missing_last",
    sql(
        "SELECT codigo, slug, costoDirecto, CAST(row_number() OVER (PARTITION BY codigo ORDER BY CASE WHEN costoDirecto>0 THEN equipo END DESC NULLS LAST, slug) AS INTEGER) AS baja, "
        "CAST(row_number() OVER (PARTITION BY codigo ORDER BY CASE WHEN costoDirecto>0 THEN equipo END ASC NULLS LAST, slug) AS INTEGER) AS sube FROM apus",
        "apus",
    ),
)
def sort_missing_last(spark, sf):
    from pyspark.sql import Window as W

    key = S.missing_last_key("equipo")
    per_item = W.partitionBy("codigo")
    ranked = T.facts(spark, sf).select(
        "codigo", "slug", "costoDirecto", "equipo",
        F.row_number().over(per_item.orderBy(key.desc_nulls_last(), "slug")).alias("baja"),
        F.row_number().over(per_item.orderBy(key.asc_nulls_last(), "slug")).alias("sube"),
    )
    return S.sort_missing_last(ranked, "equipo", True, "codigo", "slug").drop("equipo")


@query("sort_lines", sql("SELECT codigo, slug, orden, componente, CAST(subtotal AS DOUBLE) AS subtotal FROM ordenadas", "ordenadas"))
def sort_lines(spark, sf):
    rows = T.with_order(T.lines(spark, sf)).select("codigo", "slug", "orden", "componente", F.col("subtotal").cast("double"))
    return S.sort_lines(rows, "subtotal", descending=True)


@query(
    "top_dispersed",
    sql(
        "SELECT codigo, string_split(descripcion, chr(10))[1] AS titulo, unidad, max/mediana AS razon, min, max, mediana FROM cat "
        f"WHERE mediana>0 AND conDato>=10 ORDER BY razon DESC, {natural('codigo')} LIMIT 10",
        "cat",
    ),
)
def top_dispersed(spark, sf):
    return R.top_dispersed(A.catalog(T.facts(spark, sf)))


@query("sort_supply", sql("SELECT codigoInsumo, slug, precio FROM insumos", "insumos"))
def sort_supply(spark, sf):
    return S.sort_supply(T.supplies(spark, sf).select("codigoInsumo", "slug", "precio"))
