"""Projections, column cleaning and markup over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from preciario.constants import UNIDADES
from preciario.functions import codes, money, text
from preciario.operators import aggregates as A
from preciario.operators import clean, markup as M
from preciario.plans.analytics import NUMERO
from preciario.plans.oracle import money as rounded, sql
from preciario.plans.registry import query
from preciario.session import scratch_path
from preciario.sources import storage as S
from preciario.sources import tables as T

COMPONENTES = ("equipo", "materiales", "transporte", "manoDeObra")


@query(
    "flatten_apu",
    sql(
        "SELECT vigencia, archivo, regionCodigo, regionCodigoDane, departamento, provincia, slug, codigo, capitulo, capituloNumero, capituloNombre, "
        "articulo, clasificacion, descripcion, unidad, unidadCruda, "
        + ", ".join(f"{rounded(c)} AS {c}" for c in (*COMPONENTES, "costoDirecto"))
        + ", notaFuente FROM apus",
        "apus",
    ),
)
def flatten_apu(spark, sf):
    """Documents without their lines, which the flat row has no place for."""
    return clean.flatten_apu(clean.nested_apu(T.facts(spark, sf), F.lit(None)))


@query(
    "explode_lines",
    sql(
        "SELECT vigencia, regionCodigo, slug, departamento, provincia, codigo, orden, componente, codigoInsumo, descripcion, unidad, unidadCruda, cantidad, precioUnitario, "
        "CAST(subtotal AS DOUBLE) AS subtotal, NULL::DOUBLE AS porcentaje, NULL::DOUBLE AS base, distancia, jornal, factorPrestacional FROM ordenadas",
        "ordenadas",
    ),
)
def explode_lines(spark, sf):
    """The lines of documents as written: streamed out, streamed in."""
    path = S.sink_apu_docs(T.facts(spark, sf), T.with_order(T.lines(spark, sf)), scratch_path(spark, "apus-json"))
    return clean.explode_lines(S.scan_apu_docs(spark, path))


@query(
    "explode_supplies",
    sql(
        "SELECT vigencia, regionCodigo, slug, departamento, provincia, codigoInsumo, componente, descripcion, unidad, unidadCruda, categoria, precio, factorPrestacional FROM insumos",
        "insumos",
    ),
)
def explode_supplies(spark, sf):
    """One list per region, as published."""
    path = S.sink_supply_lists(T.supplies(spark, sf), scratch_path(spark, "insumos-json"))
    return clean.explode_supplies(S.scan_supply_lists(spark, path))


#: The driver's texts with the defects cleaning must undo.
DIRTY = (
    "chr(13)||chr(10)||'  '||replace(replace(replace(text, ' ', ' '||chr(9)||chr(160)), chr(10), ' '||chr(13)||chr(10)||' '), 'é', 'e'||chr(769))||chr(160)||' '"
)
CLEANED = (
    "nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({x}), '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{00A0}}]+', ' ', 'g'), "
    "' *\\n *', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g'), ' '), '')"
)


def _dirty_text():
    value = F.replace("text", F.lit(" "), F.lit(" \t\u00a0"))
    value = F.replace(value, F.lit("\n"), F.lit(" \r\n "))
    value = F.replace(value, F.lit("\u00e9"), F.lit("e\u0301"))
    return F.concat(F.lit("\r\n  "), value, F.lit("\u00a0 "))


@query("clean_text", f"SELECT doc_id, {CLEANED.format(x=DIRTY)} AS texto FROM documents")
def clean_text(spark, sf):
    docs = T.documents(spark, sf).select("doc_id", _dirty_text().alias("texto"))
    return clean.clean_cells(docs, "texto")


@query(
    "split_description",
    "SELECT doc_id, trim(l[1]) AS titulo, l[1] AS primeraLinea, nullif(trim(r, chr(10)||' '), '') AS alcance, "
    "CASE WHEN starts_with(s,'(') AND ends_with(s,')') AND length(s)>1 THEN trim(substr(s,2,length(s)-2), chr(10)||' ') ELSE s END AS alcanceSinParentesis, "
    "nullif(trim(replace(r, chr(10), ' ')), '') AS alcanceEnLinea FROM ("
    "SELECT *, coalesce(trim(r, chr(10)||' '), '') AS s FROM (SELECT doc_id, string_split(d, chr(10)) AS l, CASE WHEN contains(d, chr(10)) THEN substr(d, position(chr(10) IN d)+1) END AS r FROM ("
    "SELECT doc_id, CASE WHEN doc_id%3=0 THEN text ELSE lang||' '||source||' '||chr(10)||'( '||text||' )' END AS d FROM documents)))",
)
def split_description(spark, sf):
    wrapped = F.concat("lang", F.lit(" "), "source", F.lit(" \n( "), "text", F.lit(" )"))
    docs = T.documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(wrapped).alias("descripcion"))
    return clean.split_descriptions(docs).drop("descripcion")


@query(
    "normalize_code",
    "SELECT p_partkey, replace(c,'.',',') AS hoja, replace(replace(c,'.',','),',','.') AS codigo FROM (SELECT p_partkey, "
    "nullif(CASE p_partkey%4 WHEN 0 THEN ' '||CAST(200+p_size AS VARCHAR)||',4,1 ' WHEN 1 THEN CAST(200+p_size AS VARCHAR)||'.4' WHEN 2 THEN '   ' ELSE CAST(200+p_size AS VARCHAR)||'.'||CAST(p_size AS VARCHAR) END, '   ') AS c0, trim(c0) AS c FROM part)",
)
def normalize_code(spark, sf):
    base = (F.lit(200) + F.col("p_size")).cast("string")
    key = F.col("p_partkey") % 4
    raw = (
        F.when(key == 0, F.concat(F.lit(" "), base, F.lit(",4,1 ")))
        .when(key == 1, (F.lit(200) + F.col("p_size") + 0.4).cast("string"))
        .when(key == 2, F.lit("   "))
        .otherwise(F.concat(base, F.lit("."), F.col("p_size").cast("string")))
    )
    return clean.normalize_codes(T.read(spark, sf, "part").select("p_partkey", raw.alias("crudo")), "crudo").drop("crudo")


#: Raw spellings dealt over the parts: known, known by lower case, by pattern, unknown.
SPELLINGS = (*UNIDADES, "HA", "KG", "M2", "M 3 - KM", "m3-E", "m3  -  km", "Global", "gl", "ML", "  ")


def _spelling_sql() -> str:
    arms = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SPELLINGS))
    return f"CASE p_partkey%{len(SPELLINGS)} {arms} END"


_KNOWN = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UNIDADES.items()) + " END"
_LOWER = "CASE lower(c) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UNIDADES.items()) + " END"
UNITS = (
    f"SELECT p_partkey, coalesce(k, c) AS unidad, CASE WHEN c <> coalesce(k, c) THEN c END AS unidadCruda, CASE WHEN c IS NOT NULL THEN k IS NOT NULL END AS conocida FROM ("
    f"SELECT p_partkey, c, coalesce({_KNOWN}, {_LOWER}, CASE WHEN regexp_full_match(c, '(?i)m\\s*3\\s*-\\s*(km|e)') THEN 'm3-km' END) AS k FROM ("
    f"SELECT p_partkey, nullif(trim(regexp_replace({_spelling_sql()}, ' +', ' ', 'g')), '') AS c FROM part))"
)


def _spelled(spark, sf):
    spelling = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("p_partkey") % len(SPELLINGS) + 1).cast("int"))
    return T.read(spark, sf, "part").select("p_partkey", spelling.alias("crudo"))


@query("canonical_unit", UNITS)
def canonical_unit(spark, sf):
    return clean.canonical_units(_spelled(spark, sf), "crudo").drop("crudo")


@query("unknown_units", f"SELECT unidad, count(*) AS n FROM ({UNITS}) WHERE NOT conocida GROUP BY unidad")
def unknown_units(spark, sf):
    return clean.unknown_units(_spelled(spark, sf), "crudo")


@query(
    "title_case_names",
    "SELECT p_partkey, array_to_string(list_transform(string_split(n,' '), lambda w, i: CASE WHEN i>1 AND w IN ('de','del','la','las','los','el','y','e') THEN w "
    "WHEN regexp_matches(w, '^[a-záéíóúüñ]') THEN upper(w[1])||substr(w,2) ELSE w END), ' ') AS nombre FROM ("
    "SELECT p_partkey, 'la '||replace(p_name,' ',' de la ')||' éxito y '||lower(p_type) AS n FROM part)",
)
def title_case_names(spark, sf):
    raw = F.upper(F.concat(F.lit(" la_"), F.replace("p_name", F.lit(" "), F.lit("_DE__LA ")), F.lit("_éxito  y "), "p_type"))
    return clean.title_names(T.read(spark, sf, "part").select("p_partkey", raw.alias("crudo")), "crudo", "nombre").drop("crudo")


@query(
    "text_equivalent",
    "SELECT doc_id, true AS igual, lower(strip_accents(trim(text))) = lower(strip_accents(trim(lang||text))) AS distinto FROM documents",
)
def text_equivalent(spark, sf):
    spaced = F.concat(F.lit("  "), F.replace(F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))), F.lit(" "), F.lit("  \t")), F.lit(" "))
    plain = F.replace("text", F.lit("ß"), F.lit("ss"))
    return T.documents(spark, sf).select(
        "doc_id",
        text.equivalent(F.translate(plain, "éèêÉÈÊ", "eeeEEE"), spaced).alias("igual"),
        text.equivalent(F.col("text"), F.concat("lang", "text")).alias("distinto"),
    )


@query(
    "slugify",
    "SELECT doc_id, trim(regexp_replace(lower(strip_accents(lang||' '||text)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents",
)
def slugify(spark, sf):
    docs = T.documents(spark, sf).select("doc_id", "lang", "text")
    return clean.slugs(docs, "slug", "lang", "text").select("doc_id", "slug")


@query(
    "dane_prefix",
    sql(
        "SELECT regionCodigo, left(regionCodigo,2) AS regionCodigoDane, CASE left(regionCodigo,2) WHEN '05' THEN 'Antioquia' WHEN '08' THEN 'Atlántico' "
        "WHEN '11' THEN 'Bogotá D.C.' WHEN '17' THEN 'Caldas' END AS nombreDepartamento FROM insumos",
        "insumos",
    ),
)
def dane_prefix(spark, sf):
    return clean.department_prefix(T.supplies(spark, sf).select("regionCodigo"))


PRODUCT = "l_extendedprice*l_discount*(1+l_tax)"


@query("round_money", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rounded(PRODUCT)} AS valor FROM lineitem")
def round_money(spark, sf):
    value = F.col("l_extendedprice") * F.col("l_discount") * (1 + F.col("l_tax"))
    return T.lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.round_money(value).alias("valor"))


@query("chapter_prefix", sql("SELECT codigo, slug, string_split(codigo,'.')[1] AS capitulo FROM lineas", "lineas"))
def chapter_prefix(spark, sf):
    return T.lines(spark, sf).select("codigo", "slug", codes.chapter_prefix(F.col("codigo")).alias("capitulo"))


@query(
    "chapter_label_split",
    "SELECT p_partkey, CASE WHEN p_partkey%4<2 THEN p_size END AS capituloNumero, CASE p_partkey%4 WHEN 0 THEN p_name WHEN 1 THEN p_name||' '||p_type END AS capituloNombre FROM part",
)
def chapter_label_split(spark, sf):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    label = (
        F.when(key == 0, F.concat(F.lit("Capitulo "), size, F.lit("\n"), "p_name"))
        .when(key == 1, F.concat(F.lit("  CAPÍTULO  "), size, F.lit("\n  "), "p_name", F.lit("\n"), "p_type", F.lit(" ")))
        .when(key == 2, F.concat(F.lit("Capitulo "), size))
        .otherwise(F.concat("p_name", F.lit(" capitulo 3 x")))
    )
    return clean.chapter_labels(T.read(spark, sf, "part").select("p_partkey", label.alias("t")), "t").drop("t")


@query(
    "chapter_fallback",
    sql(f"SELECT codigo, slug, {NUMERO} AS capituloNumero, coalesce(capituloNombre,'Capítulo '||left(capitulo,1)) AS capituloNombre FROM apus", "apus"),
)
def chapter_fallback(spark, sf):
    return clean.chapters(T.facts(spark, sf)).select("codigo", "slug", "capituloNumero", "capituloNombre")


@query(
    "thin_projection",
    sql(
        f"SELECT codigo, string_split(descripcion,chr(10))[1] AS titulo, unidad, {NUMERO} AS capitulo, coalesce(capituloNombre,'Capítulo '||left(capitulo,1)) AS capituloNombre, mediana, conDato FROM cat",
        "cat",
    ),
)
def thin_projection(spark, sf):
    return clean.thin_search_rows(A.catalog(T.facts(spark, sf)))


@query(
    "line_amount",
    sql(
        "SELECT codigo, slug, l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE componente WHEN 'transporte' THEN cantidad*1.0::DOUBLE*precioUnitario "
        "WHEN 'manoDeObra' THEN CASE WHEN cantidad<>0 THEN precioUnitario/cantidad ELSE 0 END ELSE cantidad*precioUnitario END AS importe FROM lineas",
        "lineas",
    ),
)
def line_amount(spark, sf):
    amount = money.line_amount(F.col("componente"), F.col("cantidad"), F.col("precioUnitario"), F.col("distancia"))
    return T.lines(spark, sf).select("codigo", "slug", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount.alias("importe"))


# ---------------------------------------------------------------- markup

SCENARIOS = (("base", 0, 0, 0, "ninguna"), ("obra", 15, 3, 5, "utilidad"), ("alto", 22.5, 4.5, 8, "utilidad"), ("sin iva", 10, 2, 5, "ninguna"))
SCENARIO_SQL = "(VALUES ('base',0.0::DOUBLE,0.0::DOUBLE,0.0::DOUBLE,'ninguna'),('obra',15,3,5,'utilidad'),('alto',22.5,4.5,8,'utilidad'),('sin iva',10,2,5,'ninguna')) e(escenario,a,i,u,b)"


def _scenarios(spark, sf):
    facts = T.facts(spark, sf).select("codigo", "slug", "costoDirecto")
    return M.with_scenarios(facts, M.scenarios(*SCENARIOS))


@query(
    "markup_columns",
    sql(
        "SELECT codigo, slug, escenario, administracion, imprevistos, utilidad, t AS totalAiu, costoDirecto+t AS subtotal, iva, costoDirecto+t+iva AS total, CASE WHEN costoDirecto>0 THEN t/costoDirecto ELSE 0 END AS fraccionAiu FROM ("
        "SELECT *, administracion+imprevistos+utilidad AS t, CASE WHEN b='utilidad' THEN utilidad*0.19::DOUBLE ELSE 0 END AS iva FROM ("
        f"SELECT *, costoDirecto*(a/100) AS administracion, costoDirecto*(i/100) AS imprevistos, costoDirecto*(u/100) AS utilidad FROM apus CROSS JOIN {SCENARIO_SQL}))",
        "apus",
    ),
)
def markup_columns(spark, sf):
    out = M.markup_columns(_scenarios(spark, sf))
    return out.select(
        "codigo", "slug", "escenario", "administracion", "imprevistos", "utilidad", "totalAiu", "subtotal", "iva", "total", "fraccionAiu"
    )


@query(
    "markup_pct_total",
    sql(f"SELECT codigo, slug, escenario, a+i+u AS porcentajeTotal, a+i+u=0 AS esCero FROM apus CROSS JOIN {SCENARIO_SQL}", "apus"),
)
def markup_pct_total(spark, sf):
    return M.markup_pct_total(_scenarios(spark, sf)).select("codigo", "slug", "escenario", "porcentajeTotal", "esCero")


@query(
    "clamp_percent",
    "SELECT event_id, CASE WHEN event_id%7=0 THEN 0 WHEN event_id%7=1 THEN 0 ELSE CASE WHEN v<=0 THEN 0 ELSE least(v,100) END END AS porcentaje FROM ("
    "SELECT event_id, CASE event_id%7 WHEN 2 THEN k WHEN 3 THEN k+0.5 WHEN 4 THEN -k WHEN 5 THEN k*100 ELSE k END AS v FROM ("
    "SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k FROM events))",
)
def clamp_percent(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1)
    case = F.col("event_id") % 7
    raw = (
        F.when(case == 0, F.concat(F.lit("perro "), k))
        .when(case == 1, F.lit("Infinity"))
        .when(case == 2, F.concat(F.lit("  "), k, F.lit("x")))
        .when(case == 3, F.concat(k, F.lit(".5 %")))
        .when(case == 4, F.concat(F.lit("-"), k))
        .when(case == 5, F.concat(k, F.lit("e2")))
        .otherwise(k)
    )
    return T.read(spark, sf, "events").select("event_id", money.clamp_percent(raw).alias("porcentaje"))


@query(
    "markup_sweep",
    sql("SELECT codigo, slug, CAST(p AS INTEGER) AS porcentaje, costoDirecto*(1+p/100) AS total FROM apus CROSS JOIN range(0,41,2) r(p)", "apus"),
)
def markup_sweep(spark, sf):
    return M.markup_sweep(T.facts(spark, sf).select("codigo", "slug", "costoDirecto")).drop("costoDirecto")
