"""Joins, filters and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from preciario.operators import aggregates as A
from preciario.operators import clean, filters as P, joins as J, ranking as R, sets as U
from preciario.plans.analytics import BREAKDOWN, FAMILY, NUMERO, _featured
from preciario.plans.oracle import sql
from preciario.plans.registry import query
from preciario.sources import tables as T


@query(
    "join_chapter_map",
    sql("SELECT codigo, slug, m.numero, m.nombre FROM apus JOIN cmap m USING (capitulo)", "cmap"),
)
def join_chapter_map(spark, sf):
    facts = T.facts(spark, sf)
    mapping = J.chapter_map(A.catalog(facts))
    return J.join_chapter_map(facts, mapping).select("codigo", "slug", "numero", "nombre")


@query(
    "join_national_median",
    sql("SELECT codigo, slug, costoDirecto, mediana AS medianaNacional FROM apus JOIN (SELECT codigo, mediana FROM cat WHERE mediana>0) USING (codigo) WHERE costoDirecto>0", "cat"),
)
def join_national_median(spark, sf):
    facts = T.facts(spark, sf)
    return J.join_national_median(facts, A.catalog(facts)).select("codigo", "slug", "costoDirecto", "medianaNacional")


@query(
    "semi_comparable_items",
    sql(
        "SELECT slug, numero, comparables, CASE WHEN comparables>0 THEN comparables ELSE todos END AS base FROM ("
        "SELECT slug, m.numero, count(*) FILTER (WHERE costoDirecto>0) AS comparables FROM apus JOIN cmap m USING (capitulo) GROUP BY ALL) "
        "JOIN (SELECT m.numero, count(*) AS todos FROM cat JOIN cmap m USING (capitulo) GROUP BY ALL) USING (numero)",
        "cmap",
    ),
)
def semi_comparable_items(spark, sf):
    facts = T.facts(spark, sf)
    cat = A.catalog(facts)
    return J.semi_comparable_items(facts, cat, J.chapter_map(cat))


@query(
    "join_featured",
    _featured("SELECT CAST(posicion AS INTEGER) AS posicion, codigo, unidad, cat.mediana, conDato FROM o JOIN cat USING (codigo) WHERE posicion<=60"),
)
def join_featured(spark, sf):
    cat = A.catalog(T.facts(spark, sf))
    featured = R.featured_round_robin(cat, limit=60, chapter=FAMILY)
    return J.join_featured(featured, cat).select("posicion", "codigo", "unidad", "mediana", "conDato").orderBy("posicion")


@query(
    "join_item_region_breakdown",
    sql(
        f"SELECT b.codigo, b.slug, b.componente, b.subtotal, b.total, a.costoDirecto, p.departamento, p.provincia FROM ({BREAKDOWN}) b "
        "JOIN apus a ON a.codigo=b.codigo AND a.slug=b.slug JOIN prov p ON p.slug=b.slug",
        "prov",
    ),
)
def join_item_region_breakdown(spark, sf):
    facts = T.facts(spark, sf)
    joined = J.join_item_region_breakdown(A.breakdown(T.lines(spark, sf)), facts, A.province_summary(facts))
    return joined.select("codigo", "slug", "componente", "subtotal", "total", "costoDirecto", "departamento", "provincia")


@query(
    "anti_orphans",
    sql(
        "SELECT codigo, slug, 'sin líneas' AS lado FROM apus WHERE capitulo='340' UNION ALL "
        "SELECT DISTINCT codigo, slug, 'sin ítem' FROM lineas WHERE capitulo='312'",
        "apus",
    ),
)
def anti_orphans(spark, sf):
    """Facts of one chapter are removed on one side, lines of another on the other."""
    facts = T.facts(spark, sf).where(F.col("capitulo") != "312")
    return J.anti_orphans(facts, T.lines(spark, sf).where(F.col("capitulo") != "340"))


@query(
    "cross_item_region",
    sql("SELECT codigo, slug FROM (SELECT DISTINCT codigo FROM apus) CROSS JOIN (SELECT DISTINCT slug FROM apus)", "apus"),
)
def cross_item_region(spark, sf):
    facts = T.facts(spark, sf)
    return J.cross_item_region(facts.select("codigo").distinct(), facts.select("slug").distinct())


@query(
    "missing_pairs",
    sql(
        "SELECT codigo, slug FROM (SELECT DISTINCT codigo FROM apus) CROSS JOIN (SELECT DISTINCT slug FROM apus) "
        "EXCEPT SELECT codigo, slug FROM apus",
        "apus",
    ),
)
def missing_pairs(spark, sf):
    return J.missing_pairs(T.facts(spark, sf).select("codigo", "slug"))


@query(
    "join_dept_name",
    sql(
        "SELECT slug, regionCodigoDane, departamento, CASE regionCodigoDane WHEN '05' THEN 'Antioquia' WHEN '08' THEN 'Atlántico' WHEN '11' THEN 'Bogotá D.C.' "
        "WHEN '17' THEN 'Caldas' ELSE departamento END AS nombreDepartamento FROM prov",
        "prov",
    ),
)
def join_dept_name(spark, sf):
    rows = A.province_summary(T.facts(spark, sf)).select("slug", "regionCodigoDane", "departamento")
    return J.join_dept_name(rows)


# ---------------------------------------------------------------- filters


@query(
    "filter_applicable",
    sql(
        "SELECT codigo, count(*) FILTER (WHERE costoDirecto>0) AS aplica, count(*) FILTER (WHERE NOT costoDirecto>0) AS noAplica FROM apus GROUP BY codigo",
        "apus",
    ),
)
def filter_applicable(spark, sf):
    return P.applicable_counts(T.facts(spark, sf), ["codigo"])


FOLDED = "regexp_replace(strip_accents(lower({x})), '[´^`¨]', '', 'g')"


@query(
    "search_item",
    f"SELECT doc_id FROM documents WHERE contains(lang, 'cion') OR contains({FOLDED.format(x='text')}, 'cion')",
)
def search_item(spark, sf):
    docs = T.documents(spark, sf)
    return P.search_item(docs, "  CIÓN ", code="lang", title="text").select("doc_id")


@query(
    "search_any",
    f"SELECT doc_id, source FROM documents WHERE contains({FOLDED.format(x='source')}, 'eme') OR contains({FOLDED.format(x='text')}, 'eme') OR contains({FOLDED.format(x='lang')}, 'eme')",
)
def search_any(spark, sf):
    docs = T.documents(spark, sf)
    return P.search_any(docs, ["source", "text", "lang"], "ÊmÉ").select("doc_id", "source")


@query(
    "filter_chapter",
    sql(
        f"SELECT codigo, titulo, capitulo, mediana FROM (SELECT codigo, string_split(descripcion, chr(10))[1] AS titulo, {NUMERO} AS capitulo, mediana FROM cat) "
        "WHERE capitulo=5 AND (contains(lower(codigo),'bolt') OR contains(lower(titulo),'bolt'))",
        "cat",
    ),
)
def filter_chapter(spark, sf):
    rows = clean.thin_search_rows(A.catalog(T.facts(spark, sf)))
    return P.filter_chapter(rows, 5, "BÓLT").select("codigo", "titulo", "capitulo", "mediana")


@query(
    "guard_keys",
    "SELECT l_orderkey, l_linenumber, codigo, slug FROM (SELECT l_orderkey, l_linenumber, "
    "CASE WHEN l_linenumber=1 THEN '..'||CAST(l_partkey AS VARCHAR) ELSE CAST(100+l_partkey%900 AS VARCHAR)||'.'||CAST(l_linenumber AS VARCHAR) END AS codigo, "
    "CASE WHEN l_suppkey%2=0 THEN 'Region_'||CAST(l_suppkey AS VARCHAR) ELSE 'region-'||CAST(l_suppkey AS VARCHAR) END AS slug FROM lineitem) "
    "WHERE regexp_full_match(codigo, '\\d{3}(\\.\\d+)*') AND regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*')",
)
def guard_keys(spark, sf):
    text = lambda c: F.col(c).cast("string")
    asked = T.lineitem(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit(".."), text("l_partkey")))
        .otherwise(F.concat((100 + F.col("l_partkey") % 900).cast("string"), F.lit("."), text("l_linenumber")))
        .alias("codigo"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Region_"), text("l_suppkey")))
        .otherwise(F.concat(F.lit("region-"), text("l_suppkey")))
        .alias("slug"),
    )
    return P.guard_keys(asked)


@query(
    "flag_partial",
    sql("SELECT codigo, conDato, conDato < (SELECT count(DISTINCT slug) FROM apus) AS parcial FROM cat", "cat"),
)
def flag_partial(spark, sf):
    facts = T.facts(spark, sf)
    total = facts.agg(F.count_distinct("slug").alias("n")).scalar()
    return P.flag_partial(A.catalog(facts), total).select("codigo", "conDato", "parcial")


@query(
    "filter_positive_lines",
    sql("SELECT codigo, slug, componente, codigoInsumo, CAST(subtotal AS DOUBLE) AS subtotal FROM lineas WHERE subtotal>0", "lineas"),
)
def filter_positive_lines(spark, sf):
    kept = P.filter_positive_lines(T.lines(spark, sf))
    return kept.select("codigo", "slug", "componente", "codigoInsumo", F.col("subtotal").cast("double"))


# ---------------------------------------------------------------- sets


@query(
    "union_sources",
    "SELECT year(l_shipdate) AS anio, count(*) AS n, count(nota) AS conNota FROM ("
    "SELECT l_shipdate, NULL AS nota FROM lineitem WHERE l_returnflag='A' UNION ALL SELECT l_shipdate, l_linestatus FROM lineitem WHERE l_returnflag<>'A') GROUP BY 1",
)
def union_sources(spark, sf):
    rows = T.lineitem(spark, sf)
    first = rows.where(F.col("l_returnflag") == "A").select("l_shipdate")
    second = rows.where(F.col("l_returnflag") != "A").select("l_shipdate", F.col("l_linestatus").alias("nota"))
    table = U.union_sources(first, second)
    return table.groupBy(F.year("l_shipdate").cast("long").alias("anio")).agg(F.count(F.lit(1)).alias("n"), F.count("nota").alias("conNota"))


INVENTORY = (
    "SELECT 'indice' AS tipo, * FROM (VALUES ('', 1.0::DOUBLE), ('/items', 0.9), ('/provincias', 0.9), ('/aiu', 0.6)) v(url, prioridad) UNION ALL "
    "SELECT DISTINCT 'item', '/items/'||codigo, 0.8 FROM apus UNION ALL SELECT DISTINCT 'provincia', '/provincias/'||slug, 0.7 FROM apus UNION ALL "
    "SELECT 'desglose', '/items/'||codigo||'/'||slug, 0.5 FROM (SELECT DISTINCT codigo FROM apus) CROSS JOIN (SELECT DISTINCT slug FROM apus)"
)


@query("union_key_inventory", sql(INVENTORY, "apus"))
def union_key_inventory(spark, sf):
    return U.union_key_inventory(spark, T.facts(spark, sf).select("codigo", "slug"))


@query("inventory_count", sql(f"SELECT count(*) AS urls FROM ({INVENTORY})", "apus"))
def inventory_count(spark, sf):
    return U.inventory_count(T.facts(spark, sf).select("codigo", "slug"))


@query("distinct_keys", sql("SELECT DISTINCT codigo, unidadCruda FROM lineas", "lineas"))
def distinct_keys(spark, sf):
    return U.distinct_keys(T.lines(spark, sf), "codigo", "unidadCruda")
