"""Sources and sinks over the driver tables: each query writes below the shared
folder and reads back what it wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from preciario.functions.money import sum_money
from preciario.operators import aggregates as A, extract as X
from preciario.plans.oracle import natural, sql, stats
from preciario.plans.registry import query
from preciario.session import scratch_path
from preciario.sources import schemas, storage as S
from preciario.sources import tables as T
from preciario.sources.layout import SECCIONES_ANCHAS

APU_COLUMNS = ", ".join(f.name for f in schemas.APUS)
LINE_COLUMNS = (
    "vigencia, regionCodigo, slug, departamento, provincia, codigo, orden, componente, codigoInsumo, descripcion, unidad, unidadCruda, cantidad, precioUnitario, "
    "CAST(subtotal AS DOUBLE) AS subtotal, NULL::DOUBLE AS porcentaje, NULL::DOUBLE AS base, distancia, jornal, factorPrestacional"
)
SUPPLY_COLUMNS = ", ".join(f.name for f in schemas.INSUMOS)
APU_SQL = sql(f"SELECT {APU_COLUMNS} FROM apus", "apus")
LINE_SQL = sql(f"SELECT {LINE_COLUMNS} FROM ordenadas", "ordenadas")
SUPPLY_SQL = sql(f"SELECT {SUPPLY_COLUMNS} FROM insumos", "insumos")


def _lines(spark, sf):
    return T.with_order(T.lines(spark, sf))


def _provenance(vigencia="2026-1"):
    return F.struct(
        F.lit("Tablas de prueba").alias("fuente"),
        F.lit("https://datos.example.org/").alias("url"),
        F.lit(vigencia).alias("vigencia"),
        F.lit("2026-01-15").alias("fechaDescarga"),
        F.lit("Abierta").alias("licencia"),
    )


@query("scan_staging_apus", APU_SQL)
def scan_staging_apus(spark, sf):
    path = S.sink_staging(T.facts(spark, sf), scratch_path(spark, "apus-ndjson"), schemas.APUS)
    return S.scan_staging(spark, path, schemas.APUS)


@query("scan_staging_lineas", LINE_SQL)
def scan_staging_lineas(spark, sf):
    path = S.sink_staging(_lines(spark, sf), scratch_path(spark, "lineas-ndjson"), schemas.LINEAS, compression="gzip")
    return S.scan_staging(spark, path, schemas.LINEAS)


@query("scan_staging_insumos", SUPPLY_SQL)
def scan_staging_insumos(spark, sf):
    path = S.sink_staging(T.supplies(spark, sf), scratch_path(spark, "insumos-ndjson"), schemas.INSUMOS)
    return S.scan_staging(spark, path, schemas.INSUMOS)


@query(
    "sink_staging",
    sql(
        "SELECT codigo, count(*) AS filas, count(*) AS claves, count(*) FILTER (WHERE capituloNumero IS NULL) AS nulas, count(*) AS notas FROM apus GROUP BY codigo",
        "apus",
    ),
)
def sink_staging(spark, sf):
    """Two appended batches; every row must carry every key, nulls written out."""
    path = scratch_path(spark, "staging")
    facts = T.facts(spark, sf)
    S.sink_staging(facts.where(F.col("regionCodigoDane") < "11"), path, schemas.APUS)
    S.sink_staging(facts.where(F.col("regionCodigoDane") >= "11"), path, schemas.APUS)
    raw = spark.read.text(path)
    return raw.groupBy(F.get_json_object("value", "$.codigo").alias("codigo")).agg(
        F.count(F.lit(1)).alias("filas"),
        F.count_if(F.array_size(F.json_object_keys("value")) == len(schemas.APUS)).alias("claves"),
        F.count_if(F.contains("value", F.lit('"capituloNumero":null'))).alias("nulas"),
        F.count_if(F.contains("value", F.lit('"notaFuente":null'))).alias("notas"),
    )


@query("sink_apus_parquet", APU_SQL)
def sink_apus_parquet(spark, sf):
    return spark.read.parquet(S.sink_apus(T.facts(spark, sf), scratch_path(spark, "apus")))


@query("sink_lineas_parquet", LINE_SQL)
def sink_lineas_parquet(spark, sf):
    return spark.read.parquet(S.sink_lineas(_lines(spark, sf), scratch_path(spark, "lineas")))


@query("sink_insumos_parquet", SUPPLY_SQL)
def sink_insumos_parquet(spark, sf):
    return spark.read.parquet(S.sink_insumos(T.supplies(spark, sf), scratch_path(spark, "insumos")))


def _dated(spark, sf):
    """Lines by the half-year in which they shipped."""
    half = F.when(F.month("l_shipdate") <= 6, "1").otherwise("2")
    return T.lines(spark, sf).select(
        "codigo", "slug", "componente", "subtotal", F.concat(F.date_format("l_shipdate", "yyyy"), F.lit("-"), half).alias("vigencia")
    )


DATED = (
    "SELECT strftime(l_shipdate,'%Y')||'-'||CASE WHEN month(l_shipdate)<=6 THEN '1' ELSE '2' END AS vigencia, componente, count(*) AS n, "
    "CAST(sum(subtotal) AS DOUBLE) AS total FROM lineas GROUP BY ALL"
)


def _per_publication(rows):
    return rows.groupBy("vigencia", "componente").agg(F.count(F.lit(1)).alias("n"), sum_money(F.col("subtotal")).alias("total"))


@query("partition_vigencia", sql(DATED, "lineas"))
def partition_vigencia(spark, sf):
    path = S.partition_vigencia(_dated(spark, sf), scratch_path(spark, "por-vigencia"))
    return _per_publication(spark.read.schema("codigo string, slug string, componente string, subtotal double, vigencia string").parquet(path))


@query("overwrite_stage", sql(DATED, "lineas"))
def overwrite_stage(spark, sf):
    """A stale stage, which has other rows and more of them, is replaced as a whole."""
    path = scratch_path(spark, "etapa")
    totals = _per_publication(_dated(spark, sf))
    S.overwrite_stage(totals.unionByName(totals).withColumn("n", F.col("n") + 1), path)
    S.overwrite_stage(totals, path)
    return spark.read.schema(totals.schema).parquet(path)


LOOKUP = ("564.35", "nation-3")


@query(
    "point_lookup",
    sql(
        "SELECT codigo, slug, orden, componente, codigoInsumo, descripcion, unidad, unidadCruda, cantidad, precioUnitario, CAST(subtotal AS DOUBLE) AS subtotal, "
        f"NULL::DOUBLE AS porcentaje, NULL::DOUBLE AS base, distancia, jornal, factorPrestacional FROM ordenadas WHERE codigo='{LOOKUP[0]}' AND slug='{LOOKUP[1]}'",
        "ordenadas",
    ),
)
def point_lookup(spark, sf):
    path = S.sink_lineas(_lines(spark, sf), scratch_path(spark, "lineas"))
    return S.point_lookup(spark.read.parquet(path), *LOOKUP)


ITEM_DOCS = (
    "SELECT a.codigo, c.descripcion, c.capituloNumero, c.mediana, c.conDato AS provinciasConDato, 'Abierta' AS licencia, a.regionCodigo, a.slug, a.equipo, a.costoDirecto "
    "FROM apus a JOIN cat c USING (codigo)"
)


def _item_docs(spark, sf):
    documents = A.item_document(T.facts(spark, sf))
    return S.sink_item_docs(documents, _provenance(), scratch_path(spark, "items"))


@query("sink_item_docs", sql(ITEM_DOCS, "cat"))
def sink_item_docs(spark, sf):
    docs = S.scan_docs(spark, _item_docs(spark, sf), schemas.DOC_ITEM)
    return docs.select(
        "codigo", "descripcion", "capituloNumero", "agregados.mediana", "provinciasConDato", "procedencia.licencia", F.explode("regiones").alias("r")
    ).select(
        "codigo", "descripcion", "capituloNumero", "mediana", "provinciasConDato", "licencia",
        F.col("r.region.codigo").alias("regionCodigo"), "r.region.slug", "r.totales.equipo", "r.costoDirecto",
    )


def _province_docs(spark, sf):
    facts = T.facts(spark, sf)
    return S.sink_province_docs(A.province_summary(facts), A.province_items(facts), _provenance(), scratch_path(spark, "provincias"))


PROVINCE_DOCS = (
    "SELECT p.slug, p.departamento, p.mediana, p.conDato AS itemsConDato, 'Abierta' AS licencia, "
    f"row_number() OVER (PARTITION BY slug ORDER BY {natural('codigo')}) AS posicion, a.codigo, string_split(a.descripcion,chr(10))[1] AS titulo, a.costoDirecto FROM prov p JOIN apus a USING (slug)"
)


def _province_rows(rows):
    return rows.select(
        "documento.region.slug", "documento.region.departamento", "documento.agregados.mediana", "documento.itemsConDato", "documento.procedencia.licencia",
        "posicion", "elemento.codigo", "elemento.titulo", "elemento.costoDirecto",
    )


@query("sink_province_docs", sql(PROVINCE_DOCS, "prov"))
def sink_province_docs(spark, sf):
    return _province_rows(S.scan_province_docs(spark, _province_docs(spark, sf)))


@query("docs_by_key", sql(f"SELECT * FROM ({PROVINCE_DOCS}) WHERE slug='{LOOKUP[1]}' UNION ALL SELECT DISTINCT NULL, NULL, NULL, NULL, NULL, NULL, codigo, NULL, NULL FROM apus WHERE codigo='{LOOKUP[0]}'", "prov"))
def docs_by_key(spark, sf):
    """One province and one item by key; absent and malformed keys give no rows."""
    path, items = _province_docs(spark, sf), S.scan_docs(spark, _item_docs(spark, sf), schemas.DOC_ITEM)
    found = [_province_rows(S.province_doc(spark, path, key)) for key in (LOOKUP[1], "nation-99", "../x", "Nation-3")]
    found += [S.item_doc(items, key).select("codigo") for key in (LOOKUP[0], "999.1", "564,35", "../x")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _stats(spark, sf):
    """The statistics document with real counts, written below the shared folder."""
    unresolved = X.unresolved_lines(T.cells(spark, sf), SECCIONES_ANCHAS)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).scalar() for df in (T.lines(spark, sf), T.supplies(spark, sf), unresolved)]
    document = A.stats_document(T.facts(spark, sf), *counts)
    return S.sink_stats(document.select(*S.header(_provenance(), F.lit("2026-1")), *document.columns), scratch_path(spark, "stats"))


@query(
    "sink_catalog_stats",
    sql(
        "SELECT 'catalogo' AS parte, codigo AS clave, descripcion AS nombre, mediana AS valor, conDato AS n FROM cat UNION ALL "
        "SELECT 'conteos', k, NULL, NULL, v FROM (SELECT 'items' AS k, count(DISTINCT codigo) AS v FROM apus UNION ALL SELECT 'provincias', count(DISTINCT slug) FROM apus UNION ALL "
        "SELECT 'departamentos', count(DISTINCT regionCodigoDane) FROM apus UNION ALL SELECT 'apus', count(*) FROM apus UNION ALL SELECT 'lineas', count(*) FROM lineas UNION ALL "
        "SELECT 'insumos', count(*) FROM insumos UNION ALL SELECT 'lineasSinResolver', count(*) FROM filas WHERE l_tax>0 AND NOT l_discount>0) UNION ALL "
        f"SELECT 'costoDirecto', k, NULL, v, NULL FROM (SELECT {stats()} FROM apus) UNPIVOT (v FOR k IN (min, max, mediana, promedio)) UNION ALL "
        "SELECT 'capitulos', capitulo, NULL, NULL, count(DISTINCT codigo) FROM apus GROUP BY capitulo UNION ALL "
        "SELECT 'capitulosInvias', CAST(capituloNumero AS VARCHAR), arg_min(capituloNombre, (archivo, list_transform(string_split(codigo,'.'), lambda p: CAST(p AS BIGINT)))), NULL, count(DISTINCT codigo) "
        "FROM apus WHERE capituloNumero IS NOT NULL GROUP BY capituloNumero UNION ALL "
        "SELECT 'departamentos', regionCodigoDane, CASE regionCodigoDane WHEN '05' THEN 'Antioquia' WHEN '08' THEN 'Atlántico' WHEN '11' THEN 'Bogotá D.C.' WHEN '17' THEN 'Caldas' ELSE max(departamento) END, NULL, count(DISTINCT slug) "
        "FROM apus GROUP BY regionCodigoDane UNION ALL "
        "SELECT 'notables', 'provinciaMasBarata', arg_min(slug, (mediana, slug)), min(mediana), NULL FROM prov UNION ALL "
        "SELECT 'notables', 'provinciaMasCara', arg_max(slug, (mediana, slug)), max(mediana), NULL FROM prov UNION ALL "
        "SELECT 'cabecera', '0.1.0', 'Abierta', NULL, NULL",
        "cat", "prov", "insumos", "filas",
    ),
)
def sink_catalog_stats(spark, sf):
    """Catalog and statistics as published, every section in rows of one shape."""
    facts = T.facts(spark, sf)
    catalog = S.scan_staging(spark, S.sink_catalog(A.catalog(facts), scratch_path(spark, "catalogo")), schemas.DOC_CATALOGO_ITEM)
    document = S.scan_staging(spark, _stats(spark, sf), schemas.DOC_STATS)
    none = F.lit(None)

    def rows(df, part, key, name=none, value=none, n=none):
        return df.select(
            F.lit(part).alias("parte"), key.cast("string").alias("clave"), name.cast("string").alias("nombre"), value.cast("double").alias("valor"), n.cast("long").alias("n")
        )

    def section(name, *columns):
        return document.select(F.explode(name).alias("x")).select(*(f"x.{c}" for c in columns))

    def pairs(struct, names):
        each = F.array(*(F.struct(F.lit(c).alias("k"), F.col(f"{struct}.{c}").alias("v")) for c in names))
        return document.select(F.explode(each).alias("x")).select("x.*")

    counts = ("items", "provincias", "departamentos", "apus", "lineas", "insumos", "lineasSinResolver")
    ends = pairs("notables", ("provinciaMasCara", "provinciaMasBarata"))
    out = [
        rows(catalog, "catalogo", F.col("codigo"), F.col("descripcion"), F.col("costoDirecto.mediana"), F.col("provinciasConDato")),
        rows(pairs("conteos", counts), "conteos", F.col("k"), n=F.col("v")),
        rows(pairs("costoDirecto", A.STATS), "costoDirecto", F.col("k"), value=F.col("v")),
        rows(section("capitulos", "capitulo", "items"), "capitulos", F.col("capitulo"), n=F.col("items")),
        rows(section("capitulosInvias", "numero", "nombre", "items"), "capitulosInvias", F.col("numero"), F.col("nombre"), n=F.col("items")),
        rows(section("departamentos", "codigoDane", "nombre", "provincias"), "departamentos", F.col("codigoDane"), F.col("nombre"), n=F.col("provincias")),
        rows(ends, "notables", F.col("k"), F.col("v.slug"), F.col("v.medianaCostoDirecto")),
        rows(document, "cabecera", F.col("schemaVersion"), F.col("procedencia.licencia")),
    ]
    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    "scan_docs",
    sql("SELECT codigo, unidad, promedio, conDato AS provinciasConDato, n AS regiones FROM cat JOIN (SELECT codigo, count(*) AS n FROM apus GROUP BY codigo) USING (codigo)", "cat"),
)
def scan_docs(spark, sf):
    docs = S.scan_docs(spark, _item_docs(spark, sf), schemas.DOC_ITEM)
    return docs.select("codigo", "unidad", "agregados.promedio", "provinciasConDato", F.size("regiones").cast("long").alias("regiones"))


@query("list_item_keys", sql("SELECT codigo FROM cat", "cat"))
def list_item_keys(spark, sf):
    return S.list_item_keys(A.catalog(T.facts(spark, sf)))


@query("list_region_keys", sql("SELECT DISTINCT slug FROM apus", "apus"))
def list_region_keys(spark, sf):
    return S.list_region_keys(T.facts(spark, sf))


def _files(spark, sf):
    """The pages as if each were a file: named like a workbook, oddly, or as a temporary file."""
    key = F.col("page_id").cast("string")
    name = (
        F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("~$APU_0505_A__B_2026_1.xlsx")))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("notas "), key))
        .otherwise(F.concat(F.lit("APU_"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"), F.lit("_Depto "), key, F.lit("__Prov "), key, F.lit("_2026_1.xlsx")))
    )
    content = F.coalesce("html", F.lit(""))
    return T.read(spark, sf, "pages").select(
        F.concat(F.lit("/libros/"), name).alias("path"), F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256")
    )


FILES = (
    "SELECT CASE WHEN page_id%5=2 THEN 'notas '||CAST(page_id AS VARCHAR) ELSE 'APU_'||lpad(CAST(page_id%10000 AS VARCHAR),4,'0')||'_Depto '||CAST(page_id AS VARCHAR)||'__Prov '||CAST(page_id AS VARCHAR)||'_2026_1.xlsx' END AS filename, "
    "CASE WHEN page_id%5=2 THEN '' ELSE lpad(CAST(page_id%10000 AS VARCHAR),4,'0') END AS codigo, CASE WHEN page_id%5=2 THEN '' ELSE 'Depto '||CAST(page_id AS VARCHAR) END AS departamento, "
    "CASE WHEN page_id%5=2 THEN '' ELSE 'Prov '||CAST(page_id AS VARCHAR) END AS provincia, CAST(strlen(coalesce(html,'')) AS BIGINT) AS bytes, sha256(coalesce(html,'')) AS sha256 FROM pages WHERE page_id%7<>3"
)


@query("file_manifest", FILES)
def file_manifest(spark, sf):
    return S.file_manifest(_files(spark, sf))


@query("output_sizes", f"SELECT count(*) AS archivos, CAST(sum(bytes) AS BIGINT) AS bytes, max(bytes) AS mayor, arg_max(filename, (bytes, filename)) AS archivoMayor FROM ({FILES})")
def output_sizes(spark, sf):
    return A.output_sizes(S.file_manifest(_files(spark, sf)))


@query(
    "provenance_join",
    sql(
        "SELECT codigo, slug, costoDirecto, CASE WHEN CAST(right(regionCodigo,2) AS INTEGER)%2=0 THEN 'Tablas de prueba' END AS fuente, "
        "CASE WHEN CAST(right(regionCodigo,2) AS INTEGER)%2=0 THEN 'Abierta' END AS licencia FROM apus",
        "apus",
    ),
)
def provenance_join(spark, sf):
    """Rows of two publications, one with a complete manifest and one without a licence, read from JSON."""
    path = scratch_path(spark, "manifiesto")
    n = T.regions(spark, sf).agg(F.count(F.lit(1)).alias("archivos"))
    complete = n.select(_provenance().alias("p"), "archivos").select("p.*", "archivos")
    incomplete = complete.withColumns({"vigencia": F.lit("2025-2"), "licencia": F.lit("")})
    complete.unionByName(incomplete).write.json(path)
    odd = F.substring("regionCodigo", 3, 2).cast("int") % 2 == 1
    rows = T.facts(spark, sf).withColumn("vigencia", F.when(odd, "2025-2").otherwise(F.col("vigencia")))
    stamped = S.provenance_join(rows, S.read_manifest(spark, path))
    return stamped.select("codigo", "slug", "costoDirecto", "procedencia.fuente", "procedencia.licencia")


@query(
    "sample_first_n_files",
    sql("SELECT archivo, codigo, costoDirecto FROM apus WHERE archivo IN (SELECT DISTINCT archivo FROM apus ORDER BY archivo LIMIT 5)", "apus"),
)
def sample_first_n_files(spark, sf):
    return S.sample_first_n_files(T.facts(spark, sf), 5).select("archivo", "codigo", "costoDirecto")
