"""Data-quality queries over the driver tables.

The tables are clean by construction, so each query first breaks some rows by a
fixed rule and then finds them; all rows are checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from preciario import constants as C
from preciario.operators import aggregates as A
from preciario.operators import extract as X
from preciario.operators import quality as Q
from preciario.plans.extraction import XREF
from preciario.plans.oracle import exact, money, sql
from preciario.plans.registry import query
from preciario.sources import tables as S

REGION_NUMBER = "CAST(right(regionCodigo,2) AS INTEGER)"


@query(
    "dq_apu_rules",
    sql(
        "SELECT codigo, slug, regla, valor, CASE WHEN regla='equipo: negativo' THEN (SELECT any_value(b.equipo) FROM b WHERE b.codigo=q.codigo AND b.slug=q.slug) END AS numero FROM ("
        "SELECT codigo, slug, 'codigo: formato' AS regla, codigo AS valor FROM b WHERE NOT regexp_full_match(codigo, '\\d{3}(\\.\\d+)*') UNION ALL "
        "SELECT codigo, slug, 'descripcion: obligatorio', descripcion FROM b WHERE descripcion IS NULL OR trim(descripcion)='' UNION ALL "
        "SELECT codigo, slug, 'clasificacion: vacío', clasificacion FROM b WHERE trim(clasificacion)='' UNION ALL "
        "SELECT codigo, slug, 'equipo: negativo', CAST(NULL AS VARCHAR) FROM b WHERE equipo<0 UNION ALL "
        "SELECT codigo, slug, 'lineas: al menos una', CAST(nLineas AS VARCHAR) FROM b WHERE nLineas<1 UNION ALL "
        "SELECT codigo, slug, 'vigencia: distinta de la procedencia', pv FROM b WHERE vigencia<>pv) q",
        "apus",
    ).replace(
        " SELECT codigo, slug, regla",
        ", b AS (SELECT CASE WHEN n%7=0 THEN replace(codigo,'.',',') ELSE codigo END AS codigo, slug, vigencia, CASE WHEN n%5=0 THEN '  ' ELSE descripcion END AS descripcion, "
        "CASE WHEN n%6=0 THEN ' ' ELSE clasificacion END AS clasificacion, CASE WHEN n%8=0 THEN -1-equipo ELSE equipo END AS equipo, CASE WHEN n%9=0 THEN 0 ELSE coalesce(nl,0) END AS nLineas, "
        f"CASE WHEN n%10=0 THEN '2025-2' ELSE vigencia END AS pv FROM (SELECT a.*, {REGION_NUMBER.replace('regionCodigo', 'a.regionCodigo')} AS n, nl FROM apus a LEFT JOIN (SELECT codigo, slug, count(*) AS nl FROM lineas WHERE l_tax>0 GROUP BY ALL) c ON c.codigo=a.codigo AND c.slug=a.slug)) SELECT codigo, slug, regla",
        1,
    ),
)
def dq_apu_rules(spark, sf):
    n = F.substring("regionCodigo", 3, 2).cast("int")
    # lines that carry no tax, and those of some regions, are withheld
    counts = S.lines(spark, sf).where("l_tax > 0").groupBy("codigo", "slug").agg(F.count(F.lit(1)).alias("nLineas"))
    kept = S.facts(spark, sf).join(counts, ["codigo", "slug"], "left").withColumn("nLineas", F.when(n % 9 == 0, 0).otherwise(F.coalesce("nLineas", F.lit(0))))
    broken = kept.withColumns(
        {
            "codigo": F.when(n % 7 == 0, F.replace("codigo", F.lit("."), F.lit(","))).otherwise(F.col("codigo")),
            "descripcion": F.when(n % 5 == 0, "  ").otherwise(F.col("descripcion")),
            "clasificacion": F.when(n % 6 == 0, " ").otherwise(F.col("clasificacion")),
            "equipo": F.when(n % 8 == 0, -1 - F.col("equipo")).otherwise(F.col("equipo")),
            "procedenciaVigencia": F.when(n % 10 == 0, "2025-2").otherwise(F.col("vigencia")),
        }
    )
    found = Q.violations(broken, ["codigo", "slug"], Q.apu_rules())
    number = F.col("regla") == "equipo: negativo"
    return found.withColumns({"numero": F.when(number, F.col("valor").cast("double")), "valor": F.when(~number, F.col("valor"))})


@query(
    "dq_region_rules",
    sql(
        "SELECT provincia, regla, valor FROM (SELECT provincia, 'regionCodigo: formato' AS regla, c AS valor FROM r WHERE NOT regexp_full_match(c,'\\d{4}') UNION ALL "
        "SELECT provincia, 'regionCodigoDane: desconocido', regionCodigoDane FROM r WHERE regionCodigoDane='14' UNION ALL "
        "SELECT provincia, 'slug: formato', s FROM r WHERE NOT regexp_full_match(s,'[a-z0-9]+(-[a-z0-9]+)*') UNION ALL "
        "SELECT provincia, 'regionCodigoDane: no es prefijo', regionCodigoDane FROM r WHERE left(c,2)<>regionCodigoDane)",
        "prov",
    ).replace(
        " SELECT provincia, regla, valor FROM (SELECT",
        ", r AS (SELECT provincia, regionCodigoDane, CASE WHEN n%4=0 THEN right(regionCodigo,3) ELSE regionCodigo END AS c, CASE WHEN n%3=0 THEN upper(slug) ELSE slug END AS s "
        f"FROM (SELECT *, {REGION_NUMBER} AS n FROM prov)) SELECT provincia, regla, valor FROM (SELECT",
        1,
    ),
)
def dq_region_rules(spark, sf):
    n = F.substring("regionCodigo", 3, 2).cast("int")
    rows = A.province_summary(S.facts(spark, sf)).withColumns(
        {
            "slug": F.when(n % 3 == 0, F.upper("slug")).otherwise(F.col("slug")),
            "regionCodigo": F.when(n % 4 == 0, F.substring("regionCodigo", 2, 3)).otherwise(F.col("regionCodigo")),
        }
    )
    return Q.violations(rows, ["provincia"], Q.region_rules())


@query(
    "dq_supply_rules",
    sql(
        "SELECT codigoInsumo, slug, regla, valor FROM (SELECT codigoInsumo, slug, 'componente: desconocido' AS regla, 'viajes' AS valor FROM i WHERE n%6=0 UNION ALL "
        "SELECT codigoInsumo, slug, 'unidad: obligatorio', NULL FROM i WHERE n%5=0 UNION ALL SELECT codigoInsumo, slug, 'precio: negativo', '-5.0' FROM i WHERE n%7=0 UNION ALL "
        "SELECT codigoInsumo, slug, 'region: ajena a la lista', regionCodigo FROM i WHERE n%9=0)",
        "insumos",
    ).replace(
        " SELECT codigoInsumo, slug, regla", ", i AS (SELECT *, CAST(substr(codigoInsumo,2) AS BIGINT)+" + REGION_NUMBER + " AS n FROM insumos) SELECT codigoInsumo, slug, regla", 1
    ),
)
def dq_supply_rules(spark, sf):
    n = F.substring("codigoInsumo", 2, 20).cast("long") + F.substring("regionCodigo", 3, 2).cast("int")
    rows = S.supplies(spark, sf).withColumns(
        {
            "componente": F.when(n % 6 == 0, "viajes").otherwise(F.col("componente")),
            "unidad": F.when(n % 5 != 0, F.col("unidad")),
            "precio": F.when(n % 7 == 0, F.lit(-5.0)).otherwise(F.col("precio")),
            "listaRegion": F.when(n % 9 == 0, "9999").otherwise(F.col("regionCodigo")),
        }
    )
    return Q.violations(rows, ["codigoInsumo", "slug"], Q.supply_rules("listaRegion"))


@query(
    "dq_line_rules",
    sql(
        "SELECT codigo, slug, l_orderkey, l_linenumber, 'cantidad: negativo' AS regla, CAST(CAST(-cantidad AS DOUBLE) AS VARCHAR) AS valor FROM lineas WHERE l_linenumber=3 AND cantidad>0 UNION ALL "
        "SELECT codigo, slug, l_orderkey, l_linenumber, 'componente: desconocido', 'otro' FROM lineas WHERE l_linenumber=5 UNION ALL "
        "SELECT codigo, slug, l_orderkey, l_linenumber, 'unidad: obligatorio', chr(9)||chr(160)||chr(10) FROM lineas WHERE l_linenumber=6",
        "lineas",
    ),
)
def dq_line_rules(spark, sf):
    rows = S.lines(spark, sf).withColumns(
        {
            "cantidad": F.when(F.col("l_linenumber") == 3, -F.col("cantidad")).otherwise(F.col("cantidad")),
            "componente": F.when(F.col("l_linenumber") == 5, "otro").otherwise(F.col("componente")),
            "unidad": F.when(F.col("l_linenumber") == 6, "\t\u00a0\n").otherwise(F.col("unidad")),
        }
    )
    return Q.violations(rows, ["codigo", "slug", "l_orderkey", "l_linenumber"], Q.line_rules())


@query(
    "dq_artifact_rules",
    sql(
        "SELECT 'catalogo' AS documento, codigo AS clave, 'capitulo: formato' AS regla, 'x'||capitulo AS valor FROM cat WHERE capitulo IN ('200','228') UNION ALL "
        "SELECT 'catalogo', codigo, 'capituloNumero: no positivo', '0' FROM cat WHERE capituloNumero=7 UNION ALL "
        "SELECT 'catalogo', codigo, 'mediana: negativo', '-1.0' FROM cat WHERE conDato<10 UNION ALL "
        "SELECT 'provincia', slug, 'regionCodigoDane: desconocido', regionCodigoDane FROM prov WHERE regionCodigoDane='14' UNION ALL "
        "SELECT 'provincia', slug, 'itemsConDato: negativo', '-1' FROM prov WHERE regionCodigoDane='17' UNION ALL "
        "SELECT 'stats', 'stats', 'insumos: negativo', NULL UNION ALL "
        "SELECT 'item', codigo, 'vigencia: formato', '2026-1'||chr(10) FROM cat WHERE capitulo='200' UNION ALL "
        "SELECT 'item', codigo, 'generadoPor: obligatorio', chr(160) FROM cat WHERE capitulo='228' UNION ALL "
        "SELECT 'item', codigo, 'regiones: al menos uno', NULL FROM cat WHERE capitulo='256' UNION ALL "
        "SELECT 'item', codigo, 'regiones: equipo negativo', CAST(count(*) AS VARCHAR) FROM apus WHERE capitulo='284' GROUP BY codigo UNION ALL "
        "SELECT 'items de provincia', slug, 'items: capitulo', CAST(count(*) AS VARCHAR) FROM apus WHERE capitulo='312' GROUP BY slug UNION ALL "
        "SELECT 'estadística', '2026-1', 'capitulos: sin ítems', CAST(count(DISTINCT capitulo) AS VARCHAR) FROM apus UNION ALL "
        "SELECT 'estadística', '2026-1', 'departamentos: código', CAST(count(DISTINCT regionCodigoDane) AS VARCHAR) FROM apus UNION ALL "
        "SELECT 'estadística', '2026-1', 'nota: obligatorio', NULL",
        "cat", "prov",
    ),
)
def dq_artifact_rules(spark, sf):
    facts = S.facts(spark, sf)
    catalog = A.catalog(facts).withColumns(
        {
            "capitulo": F.when(F.col("capitulo").isin("200", "228"), F.concat(F.lit("x"), "capitulo")).otherwise(F.col("capitulo")),
            "capituloNumero": F.when(F.col("capituloNumero") == 7, 0).otherwise(F.col("capituloNumero")),
            "mediana": F.when(F.col("conDato") < 10, -1.0).otherwise(F.col("mediana")),
        }
    )
    provinces = A.province_summary(facts).withColumn(
        "itemsConDato", F.when(F.col("regionCodigoDane") == "17", -1).otherwise(F.col("itemsConDato"))
    )
    stats = A.stats_counts(facts, F.lit(1), F.lit(None).cast("long"), F.lit(0)).withColumn("clave", F.lit("stats"))

    provenance = F.struct(F.lit("x").alias("fuente"))
    items = A.item_document(facts).withColumns(
        {
            "schemaVersion": F.lit(C.SCHEMA_VERSION),
            "vigencia": F.when(F.col("capitulo") == "200", F.concat("vigencia", F.lit("\n"))).otherwise(F.col("vigencia")),
            "generadoPor": F.when(F.col("capitulo") == "228", "\u00a0").otherwise("x"),
            "nota": F.lit("x"),
            "procedencia": provenance,
            "regiones": F.when(F.col("capitulo") == "256", F.filter("regiones", lambda r: F.lit(False)))
            .when(F.col("capitulo") == "284", F.transform("regiones", lambda r: r.withField("totales", r["totales"].withField("equipo", F.lit(-1.0)))))
            .otherwise(F.col("regiones")),
            "clave": F.col("codigo"),
        }
    )
    spoilt = F.transform("items", lambda i: i.withField("capitulo", F.when(i["capitulo"] == "312", "31").otherwise(i["capitulo"])))
    parts = A.province_document(facts).where(F.col("parte") == "312").withColumns({"items": spoilt, "clave": F.col("slug")})
    document = A.stats_document(facts, F.lit(1).cast("long"), F.lit(1).cast("long"), F.lit(0).cast("long")).withColumns(
        {
            "schemaVersion": F.lit(C.SCHEMA_VERSION),
            "vigencia": F.lit("2026-1"),
            "generadoPor": F.lit("x"),
            "nota": F.lit(None).cast("string"),
            "procedencia": provenance,
            "capitulos": F.transform("capitulos", lambda x: x.withField("items", F.lit(0))),
            "departamentos": F.transform("departamentos", lambda x: x.withField("codigoDane", F.concat(x["codigoDane"], F.lit("\n")))),
            "clave": F.lit("2026-1"),
        }
    )

    def named(df, document):
        return df.select(F.lit(document).alias("documento"), "*")

    return (
        named(Q.violations(catalog.withColumn("clave", F.col("codigo")), ["clave"], Q.catalog_rules()), "catalogo")
        .unionByName(named(Q.violations(provinces.withColumn("clave", F.col("slug")), ["clave"], Q.province_rules()), "provincia"))
        .unionByName(named(Q.violations(stats, ["clave"], Q.stats_rules()), "stats"))
        .unionByName(named(Q.violations(items, ["clave"], Q.item_rules()), "item"))
        .unionByName(named(Q.violations(parts, ["clave"], Q.province_item_rules()), "items de provincia"))
        .unionByName(named(Q.violations(document, ["clave"], Q.stats_document_rules()), "estadística"))
    )


@query(
    "dq_provenance_rules",
    "SELECT o_orderkey, regla, valor FROM ("
    "SELECT o_orderkey, 'fuente: obligatorio' AS regla, '' AS valor FROM orders WHERE o_orderkey%11=0 UNION ALL "
    "SELECT o_orderkey, 'url: formato', 'sin esquema' FROM orders WHERE o_orderkey%7=0 UNION ALL "
    "SELECT o_orderkey, 'vigencia: formato', strftime(o_orderdate,'%Y')||'-3' FROM orders WHERE o_orderkey%5=0 UNION ALL "
    "SELECT o_orderkey, 'fechaDescarga: fecha', strftime(o_orderdate,'%Y')||'-02-30' FROM orders WHERE o_orderkey%13=0 UNION ALL "
    "SELECT o_orderkey, 'licencia: obligatorio', NULL FROM orders WHERE o_orderstatus='P')",
)
def dq_provenance_rules(spark, sf):
    key, year = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    rows = S.read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("fuente"),
        F.when(key % 7 == 0, "sin esquema").otherwise("https://datos.example.org/x").alias("url"),
        F.concat(year, F.when(key % 5 == 0, "-3").otherwise("-1")).alias("vigencia"),
        F.when(key % 13 == 0, F.concat(year, F.lit("-02-30"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fechaDescarga"),
        F.when(F.col("o_orderstatus") != "P", "abierta").alias("licencia"),
    )
    return Q.violations(rows, ["o_orderkey"], Q.provenance_rules())


@query(
    "dq_unknown_fields",
    "SELECT event_id, unnest(CASE event_id%9 WHEN 2 THEN ['aiu'] WHEN 4 THEN ['(no es un objeto)'] WHEN 5 THEN ['region.extra', 'lineas[].otro', 'lineas[].base.raro'] END) AS campo "
    "FROM events WHERE event_id%9 IN (2,4,5)",
)
def dq_unknown_fields(spark, sf):
    """Objects with a known region and lines; some carry unknown fields at one level or several."""
    body = F.expr("substring(props, 1, length(props) - 1)")
    case = F.col("event_id") % 9
    known = ', "region": {"slug": "a"%s}, "lineas": [{"codigo": "x", "base": {"v": 1}}, {"codigo": "y"%s}]}'
    document = (
        F.when(case == 2, F.concat(body, F.lit(', "aiu": 1' + known % ("", ""))))
        .when(case == 4, F.lit("[1]"))
        .when(case == 5, F.concat(body, F.lit(known % (', "extra": null', ', "otro": [], "base": {"raro": {}}'))))
        .otherwise(F.concat(body, F.lit(known % ("", ""))))
    )
    line = T.StructType([T.StructField("codigo", T.StringType()), T.StructField("base", T.StructType([T.StructField("v", T.LongType())]))])
    allowed = T.StructType(
        [
            T.StructField("k", T.LongType()),
            T.StructField("region", T.StructType([T.StructField("slug", T.StringType())])),
            T.StructField("lineas", T.ArrayType(line)),
        ]
    )
    return Q.unknown_fields(S.read(spark, sf, "events").select("event_id", document.alias("doc")), "doc", allowed)


@query(
    "dq_coherence",
    sql(
        "SELECT a.codigo, a.slug, a.c AS regla, a.v AS declarado, coalesce(s.h, 0) AS hallado FROM ("
        + " UNION ALL ".join(f"SELECT codigo, slug, '{c}' AS c, {c} AS v FROM apus" for c in C.COMPONENTES)
        + f") a LEFT JOIN (SELECT codigo, slug, componente, {exact('subtotal')} AS h FROM lineas WHERE l_tax>0 GROUP BY ALL) s "
        "ON s.codigo=a.codigo AND s.slug=a.slug AND s.componente=a.c WHERE abs(coalesce(s.h,0)-a.v)>1",
        "apus",
    ),
)
def dq_coherence(spark, sf):
    """Lines without tax are withheld, so their components must not add up."""
    return Q.coherence(S.facts(spark, sf), S.lines(spark, sf).where(F.col("l_tax") > 0))


@query(
    "dq_cost_vs_index",
    sql(
        f"SELECT archivo, hoja, costoDirecto, costoIndice, abs(costoIndice-costoDirecto) AS desvio FROM ({XREF}) WHERE abs(costoIndice-costoDirecto)>0.011",
        "hojas", "listado",
    ),
)
def dq_cost_vs_index(spark, sf):
    cells = S.cells(spark, sf)
    headers = X.item_index_xref(X.header_pivot(cells), X.index_rows(cells))
    return Q.cost_vs_index(headers).select("archivo", "hoja", "costoDirecto", "costoIndice", "desvio")


@query(
    "dq_breakdown_gap",
    sql(
        f"SELECT codigo, slug, total, costoDirecto, abs(total-costoDirecto) AS descuadre FROM (SELECT codigo, slug, {money('CAST(sum(CAST(s AS DECIMAL(20,4))) AS DOUBLE)')} AS total FROM ("
        f"SELECT codigo, slug, componente, {money(exact('subtotal'))} AS s FROM lineas WHERE l_linenumber<>7 GROUP BY ALL) GROUP BY ALL) "
        "JOIN apus USING (codigo, slug) WHERE abs(total-costoDirecto)>0.011",
        "apus",
    ),
)
def dq_breakdown_gap(spark, sf):
    partial = A.breakdown(S.lines(spark, sf).where(F.col("l_linenumber") != 7))
    return Q.breakdown_gap(partial, S.facts(spark, sf))


@query("dq_unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1")
def dq_unique_keys(spark, sf):
    return Q.duplicate_keys(S.lineitem(spark, sf), "l_orderkey", "l_linenumber")


@query(
    "dq_golden_diff",
    sql(
        "SELECT codigo, CASE WHEN capitulo='200' THEN 'sobra' WHEN capitulo='228' THEN 'falta' ELSE 'difiere' END AS lado, 'conDato' AS columna, "
        "CASE WHEN capitulo<>'200' THEN CAST(CASE WHEN capitulo='256' THEN conDato+1 ELSE conDato END AS VARCHAR) END AS esperado, CASE WHEN capitulo<>'228' THEN CAST(conDato AS VARCHAR) END AS hallado "
        "FROM cat WHERE capitulo IN ('200','228','256') UNION ALL "
        "SELECT codigo, CASE WHEN capitulo='200' THEN 'sobra' ELSE 'falta' END, 'unidad', CASE WHEN capitulo='228' THEN unidad END, CASE WHEN capitulo='200' THEN unidad END FROM cat WHERE capitulo IN ('200','228')",
        "cat",
    ),
)
def dq_golden_diff(spark, sf):
    cat = A.catalog(S.facts(spark, sf))
    actual = cat.where(F.col("capitulo") != "228")
    expected = cat.where(F.col("capitulo") != "200").withColumn(
        "conDato", F.when(F.col("capitulo") == "256", F.col("conDato") + 1).otherwise(F.col("conDato"))
    )
    return Q.golden_diff(actual, expected, ["codigo"], ["unidad", "conDato"])
