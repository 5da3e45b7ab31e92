"""Sheet-cell extraction over the driver tables.

The driver's forms have unlimited line rows, so they use the wide sections.
Every query reads all cells, so the operators pick their own sheets, rows and columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from preciario.constants import HOJAS_DE_APOYO
from preciario.operators import clean, extract as X
from preciario.plans.oracle import UNIT_DIFF, UNIT_RAW, sql
from preciario.plans.registry import query
from preciario.sources import tables as T
from preciario.sources.layout import COLUMNAS, SECCIONES_ANCHAS as WIDE

COMPONENTES = ("equipo", "materiales", "transporte", "manoDeObra")

SHEETS = (
    "SELECT DISTINCT archivo, hoja FROM pos UNION SELECT DISTINCT archivo, h FROM (SELECT 'LIBRO_'||CAST(p_partkey//100 AS VARCHAR) AS archivo, "
    "unnest(CASE WHEN p_partkey%100=0 THEN ['PORTADA','ÍNDICE','EQUIPO'] WHEN p_partkey%100<4 THEN ['ÍNDICE', ['EQUIPO','MATERIALES','TRANSPORTE','MANO DE OBRA'][p_partkey%4+1], 'MANO DE OBRA'] "
    "ELSE ['ÍNDICE', ['EQUIPO','MATERIALES','TRANSPORTE','MANO DE OBRA'][p_partkey%4+1]] END) AS h FROM part)"
)


@query(
    "sheet_classify",
    sql(f"SELECT archivo, hoja, CASE WHEN regexp_full_match(hoja, '\\d+(,\\d+)*') THEN 'item' ELSE 'apoyo' END AS tipo FROM ({SHEETS})", "pos"),
)
def sheet_classify(spark, sf):
    return X.sheet_classify(T.cells(spark, sf))


HEADER = (
    "SELECT k, archivo, hoja, CASE WHEN k%23=0 THEN '999,9' ELSE replace(hoja,',','.') END AS codigo, 'ITEM '||CAST(k AS VARCHAR) AS descripcion, "
    "CASE WHEN k%2=0 THEN 'm3 - Km' WHEN k%3=0 THEN 'Kg' END AS unidad, total AS costoDirecto FROM hojas"
)


@query("header_pivot", sql(f"SELECT archivo, hoja, codigo, descripcion, unidad, costoDirecto FROM ({HEADER})", "hojas"))
def header_pivot(spark, sf):
    return X.header_pivot(T.cells(spark, sf))


@query(
    "index_rows",
    sql(
        "SELECT archivo, CAST(fila AS BIGINT) AS fila, CAST(consecutivo AS BIGINT) AS consecutivo, hoja, replace(hoja,',','.') AS codigo, descripcion, unidad, unidadCruda, capitulo, articulo, "
        "clasificacion, pr AS equipo, pr*2 AS materiales, 0.0::DOUBLE AS transporte, pr AS manoDeObra, pr*4 AS costoDirecto FROM indice",
        "indice",
    ),
)
def index_rows(spark, sf):
    return X.index_rows(T.cells(spark, sf))


SECTION = (
    "SELECT archivo, hoja, CAST(fila AS BIGINT) AS fila, componente, codigo, 'INSUMO '||CAST(l_suppkey AS VARCHAR) AS descripcion, "
    "CASE WHEN componente IN ('materiales','transporte') THEN u END AS unidad, q AS cantidad, CASE componente WHEN 'manoDeObra' THEN pr*2 ELSE pr END AS precioUnitario, "
    "CASE WHEN componente='transporte' THEN 1.0::DOUBLE END AS distancia, CASE WHEN componente='manoDeObra' THEN pr END AS jornal, "
    "CASE WHEN componente='manoDeObra' THEN 1.0+l_tax END AS factorPrestacional, CAST(m AS DOUBLE) AS subtotal FROM filas WHERE l_tax>0 AND l_discount>0"
)


@query("section_lines", sql(SECTION, "filas"))
def section_lines(spark, sf):
    return X.section_lines(T.cells(spark, sf), WIDE)


@query(
    "section_subtotals",
    sql(
        "SELECT archivo, hoja, componente, subtotal, CASE WHEN subtotal IS NULL THEN 'subtotal no numérico' END AS motivo FROM ("
        + " UNION ALL ".join(
            f"SELECT archivo, hoja, '{c}' AS componente, " + (f"CASE WHEN k%19<>0 THEN {c} END" if c == "transporte" else c) + " AS subtotal FROM hojas"
            for c in COMPONENTES
        )
        + ")",
        "hojas",
    ),
)
def section_subtotals(spark, sf):
    return X.section_subtotals(T.cells(spark, sf), WIDE)


UNRESOLVED = "SELECT archivo, hoja, componente, CAST(fila AS BIGINT) AS fila, codigo FROM filas WHERE l_tax>0 AND NOT l_discount>0"


@query("unresolved_lines", sql(UNRESOLVED, "filas"))
def unresolved_lines(spark, sf):
    return X.unresolved_lines(T.cells(spark, sf), WIDE)


@query(
    "unresolved_note",
    sql(
        "SELECT archivo, hoja, n, posicion, codigo, componente, 'El libro fuente de prueba deja '||CAST(n AS VARCHAR)||' línea'||CASE WHEN n=1 THEN '' ELSE 's' END AS inicio FROM ("
        "SELECT *, count(*) OVER (PARTITION BY archivo, hoja) AS n, row_number() OVER (PARTITION BY archivo, hoja ORDER BY "
        f"list_position(['equipo','materiales','transporte','manoDeObra'], componente), fila) AS posicion FROM ({UNRESOLVED}))",
        "filas",
    ),
)
def unresolved_note(spark, sf):
    return X.unresolved_note(X.unresolved_lines(T.cells(spark, sf), WIDE), "prueba")


MINOR = (
    "SELECT archivo, hoja, CAST(52 AS BIGINT) AS fila, 'equipo' AS componente, 'HERMENINV' AS codigo, '%' AS unidad, 0.05::DOUBLE AS cantidad, manoDeObra AS precioUnitario, "
    "floor(manoDeObra*0.05::DOUBLE*100+0.5)/100 AS subtotal, 0.05::DOUBLE AS porcentaje, manoDeObra AS base FROM hojas WHERE k%3=0"
)


@query(
    "minor_tools_line",
    sql(
        f"SELECT archivo, hoja, fila, componente, codigo, unidad, cantidad, precioUnitario, subtotal, NULL::DOUBLE AS porcentaje, NULL::DOUBLE AS base FROM ({SECTION}) UNION ALL "
        f"SELECT archivo, hoja, fila, componente, codigo, unidad, cantidad, precioUnitario, subtotal, porcentaje, base FROM ({MINOR})",
        "hojas",
    ),
)
def minor_tools_line(spark, sf):
    lines = X.sheet_lines(T.cells(spark, sf), WIDE)
    return lines.select("archivo", "hoja", "fila", "componente", "codigo", "unidad", "cantidad", "precioUnitario", "subtotal", "porcentaje", "base")


_CANON = "CASE {x} WHEN 'm3 - Km' THEN 'm3-km' WHEN 'Kg' THEN 'kg' WHEN 'm³' THEN 'm3' WHEN 'HA' THEN 'ha' ELSE {x} END"


EQUIPMENT = (
    "SELECT 'LIBRO_'||CAST(p_partkey//100 AS VARCHAR) AS archivo, 'P'||CAST(p_partkey AS VARCHAR) AS codigo, "
    f"{UNIT_RAW} AS u FROM part WHERE p_partkey%4=0 AND p_partkey%100<88"
)


@query(
    "resolve_unit",
    sql(
        f"SELECT archivo, hoja, fila, componente, codigo, {_CANON.format(x='c')} AS unidad, CASE WHEN c<>{_CANON.format(x='c')} THEN c END AS unidadCruda FROM ("
        "SELECT s.*, coalesce(s.unidad, CASE WHEN s.componente='manoDeObra' THEN 'jornal' END, e.u, 'h') AS c FROM "
        f"({SECTION}) s LEFT JOIN ({EQUIPMENT}) e ON e.archivo=s.archivo AND e.codigo=s.codigo)",
        "filas",
    ),
)
def resolve_unit(spark, sf):
    lines = X.section_lines(T.cells(spark, sf), WIDE)
    resolved = X.resolve_unit(lines, X.equipment_units(T.cells(spark, sf)))
    return resolved.select("archivo", "hoja", "fila", "componente", "codigo", "unidad", "unidadCruda")


XREF = (
    "SELECT h.archivo, h.hoja, replace(h.hoja,',','.') AS codigo, h.descripcion, coalesce(CASE h.unidad WHEN 'm3 - Km' THEN 'm3-km' WHEN 'Kg' THEN 'kg' END, i.unidad) AS unidad, "
    f"CASE WHEN h.unidad IN ('m3 - Km','Kg') THEN h.unidad ELSE i.unidadCruda END AS unidadCruda, h.costoDirecto, i.capitulo, i.articulo, i.clasificacion, i.pr*4 AS costoIndice FROM ({HEADER}) h LEFT JOIN listado i ON i.archivo=h.archivo AND i.hoja=h.hoja"
)


@query("item_index_xref", sql(XREF, "hojas", "listado"))
def item_index_xref(spark, sf):
    headers = X.header_pivot(T.cells(spark, sf))
    return X.item_index_xref(headers, X.index_rows(T.cells(spark, sf)))


VIOLATIONS = (
    "SELECT archivo, hoja, 0 AS orden, 'banner' AS regla, 'B35' AS celda, 'I. OTRA COSA' AS valor FROM hojas WHERE k%11=0 UNION ALL "
    "SELECT archivo, hoja, 3, 'etiqueta', 'B74', NULL FROM hojas WHERE k%13=0 UNION ALL SELECT archivo, hoja, 9, 'aiu', 'N109', NULL FROM hojas WHERE k%17=0"
)


@query("layout_violations", sql(VIOLATIONS, "hojas"))
def layout_violations(spark, sf):
    return X.layout_violations(T.cells(spark, sf), WIDE)


SUPPORT = ", ".join(f"'{h}'" for h in HOJAS_DE_APOYO)


@query(
    "structure_violations",
    sql(
        f"SELECT archivo, 'hojas' AS regla, 'se esperaban 106 y hay '||CAST(count(*) AS VARCHAR) AS detalle FROM ({SHEETS}) GROUP BY archivo HAVING count(*)<>106 UNION ALL "
        f"SELECT archivo, 'items', 'se esperaban 99 y hay '||CAST(count(*) AS VARCHAR) FROM ({SHEETS}) WHERE regexp_full_match(hoja, '\\d+(,\\d+)*') GROUP BY archivo HAVING count(*)<>99 UNION ALL "
        f"SELECT archivo, 'falta', h FROM (SELECT DISTINCT archivo FROM ({SHEETS})) CROSS JOIN (SELECT unnest([{SUPPORT}]) AS h) "
        f"WHERE (archivo, h) NOT IN (SELECT (archivo, hoja) FROM ({SHEETS}))",
        "pos",
    ),
)
def structure_violations(spark, sf):
    return X.structure_violations(T.cells(spark, sf), n_sheets=106, n_items=99)


def _listing(only: str) -> str:
    return (
        "SELECT 'LIBRO_'||CAST(p_partkey//100 AS VARCHAR) AS archivo, CASE p_partkey%4 WHEN 0 THEN 'equipo' WHEN 1 THEN 'materiales' WHEN 2 THEN 'transporte' ELSE 'manoDeObra' END AS componente, "
        "CAST((p_partkey%100)//4 + CASE p_partkey%4 WHEN 0 THEN 6 WHEN 3 THEN 12 ELSE 7 END AS BIGINT) AS fila, 'P'||CAST(p_partkey AS VARCHAR) AS codigo, p_name AS descripcion, "
        f"CASE WHEN p_partkey%4=3 THEN 'mes' ELSE {_CANON.format(x=f'({UNIT_RAW})')} END AS unidad, CASE WHEN p_partkey%4<>3 THEN {UNIT_DIFF} END AS unidadCruda, "
        "CASE WHEN p_partkey%4<2 THEN p_type END AS categoria, CASE WHEN p_size%7=0 THEN 0 ELSE p_retailprice END AS precio, "
        f"CASE WHEN p_partkey%4=3 THEN 2.0+p_size/100 END AS factorPrestacional FROM part WHERE p_partkey%100<88 AND (p_size%7=0 OR p_size%5<>0) AND {only}"
    )


@query("supply_listing", _listing("true"))
def supply_listing(spark, sf):
    return X.supply_listing(T.cells(spark, sf))


@query("supply_subset", _listing("p_partkey%4 IN (0, 2)"))
def supply_subset(spark, sf):
    return X.supply_listing(T.cells(spark, sf), ["EQUIPO", "TRANSPORTE"])


@query(
    "salary_reference",
    "SELECT 'LIBRO_'||CAST(p_partkey//100 AS VARCHAR) AS archivo, CAST(4+p_partkey%100 AS BIGINT) AS fila, 'Concepto '||CAST(p_partkey%100 AS VARCHAR) AS concepto, 'COP' AS unidad, "
    "p_retailprice AS valor FROM part WHERE p_partkey%100<4 AND p_partkey%100<>2",
)
def salary_reference(spark, sf):
    return X.salary_reference(T.cells(spark, sf))


COVER = (
    "SELECT 'LIBRO_'||CAST(p_partkey//100 AS VARCHAR) AS archivo, 'Norte de Santander' AS departamento, "
    "'Valle de '||array_to_string(list_transform(string_split(p_name,' '), lambda w: upper(w[1])||substr(w,2)),' ') AS provincia, '42 HORAS' AS factorHorario, "
    "CAST(p_size*10 AS DOUBLE) AS altitud, 1.0+p_size/100 AS factorAltitud, 30-p_size/5 AS temperatura, CASE WHEN (p_partkey//100)%3<>0 THEN 1.02::DOUBLE END AS factorManoDeObra "
    "FROM part WHERE p_partkey%100=0"
)


@query("cover_attributes", COVER)
def cover_attributes(spark, sf):
    return X.cover_attributes(T.cells(spark, sf))


@query(
    "region_from_filename",
    sql(
        "SELECT DISTINCT archivo, regionCodigo, departamento AS departamentoCrudo, provincia AS provinciaCruda, vigencia FROM apus UNION ALL "
        "SELECT DISTINCT 'otro '||archivo, NULL, NULL, NULL, NULL FROM apus",
        "apus",
    ),
)
def region_from_filename(spark, sf):
    good = T.facts(spark, sf).select("archivo").distinct()
    bad = good.select(F.concat(F.lit("otro "), "archivo").alias("archivo"))
    return X.region_from_filename(good.unionByName(bad))


@query(
    "region_resolve",
    sql(
        "SELECT archivo, regionCodigo, regionCodigoDane, d AS departamento, p AS provincia, CASE WHEN d IS NOT NULL THEN "
        "trim(regexp_replace(lower(strip_accents(d||' '||p)), '[^a-z0-9]+', '-', 'g'), '-') END AS slug, vigencia, CASE WHEN d IS NULL THEN 'departamento desconocido' END AS motivo FROM ("
        "SELECT DISTINCT archivo, regionCodigo, regionCodigoDane, vigencia, 'Nation '||string_split(provincia,'_')[2] AS p, CASE regionCodigoDane WHEN '05' THEN 'Antioquia' WHEN '08' THEN 'Atlántico' "
        "WHEN '11' THEN 'Bogotá D.C.' WHEN '17' THEN 'Caldas' END AS d FROM apus) UNION ALL "
        "SELECT DISTINCT 'otro '||archivo, NULL, NULL, NULL, NULL, NULL, NULL, 'nombre de archivo no reconocido' FROM apus",
        "apus",
    ),
)
def region_resolve(spark, sf):
    return X.region_resolve(region_from_filename(spark, sf))


def _filled(column):
    return F.col(f"{column}_t").isNotNull() | F.col(f"{column}_n").isNotNull()


def _changed(cells, changes):
    """Sheet rows with other cells: column -> (where, its text, its number); rows left without a cell go."""
    new = {}
    for column, (where, *values) in changes.items():
        for part, kind, value in zip("tn", ("string", "double"), values, strict=True):
            new[f"{column}_{part}"] = F.when(where, F.lit(None).cast(kind) if value is None else value).otherwise(F.col(f"{column}_{part}"))
    return cells.withColumns(new).where(X.any_cell(COLUMNAS))


def _defective(cells):
    """Form defects by the last digit of the sheet name: 7, another minor-tools code; 8, no base; 4, no
    description in the line rows; 5, no subtotal label check but a cost one peso off."""
    last = F.right("hoja", F.lit(1))

    def at(row, digit):
        return (F.col("fila") == row) & (last == digit) & F.col("hoja").rlike("^[0-9]+,[0-9]+$")

    return _changed(
        cells,
        {
            "K": (at(52, "8"), None, None),
            "C": (at(1002, "4"), None, None),
            "B": (at(52, "7") & _filled("B"), F.lit("OTRO"), F.col("B_n")),
            "N": (at(101, "5"), F.col("N_t"), F.col("N_n") + 1),
        },
    )


VERDICT = (
    "SELECT h.archivo, h.hoja, CASE WHEN v.regla IS NOT NULL THEN 'formato: '||v.regla WHEN h.k%23=0 THEN 'código distinto del nombre de la hoja' "
    "WHEN h.k%2<>0 AND h.k%3<>0 AND i.unidad IS NULL THEN 'sin unidad' WHEN d='4' AND s.segunda THEN 'línea incompleta' "
    "WHEN h.k%3=0 AND d='7' THEN 'herramienta menor: código inesperado' WHEN h.k%3=0 AND d='8' THEN 'herramienta menor: base no numérica' "
    "WHEN h.k%19=0 THEN 'subtotal no numérico' WHEN coalesce(s.n,0)=0 AND h.k%3<>0 THEN 'sin líneas' "
    "WHEN h.k%3=0 AND floor(manoDeObra*0.05::DOUBLE*100+0.5)/100>0.011 THEN 'aritmética: secciones' WHEN d='5' THEN 'aritmética: costo directo' "
    "WHEN abs(i.pr*4-h.total)>0.011 THEN 'costo distinto del índice' END AS motivo FROM (SELECT *, right(hoja,1) AS d FROM hojas) h LEFT JOIN "
    f"(SELECT archivo, hoja, arg_min(regla, orden) AS regla FROM ({VIOLATIONS}) GROUP BY ALL) v ON v.archivo=h.archivo AND v.hoja=h.hoja "
    "LEFT JOIN listado i ON i.archivo=h.archivo AND i.hoja=h.hoja "
    "LEFT JOIN (SELECT archivo, hoja, count(*) AS n, bool_or(fila=1002) AS segunda FROM filas WHERE l_tax>0 AND l_discount>0 GROUP BY ALL) s ON s.archivo=h.archivo AND s.hoja=h.hoja"
)


@query(
    "reject_rows",
    sql(VERDICT, "hojas", "listado"),
)
def reject_rows(spark, sf):
    cells = _defective(T.cells(spark, sf))
    return X.reject_rows(cells, sections=WIDE)


_GOOD = f"(SELECT archivo, hoja FROM ({VERDICT}) WHERE motivo IS NULL)"
_NONE = {"t": "NULL::VARCHAR", "d": "NULL::DOUBLE", "n": "NULL::BIGINT"}


def _row(tabla: str, **own: str) -> str:
    """A select list with all columns of the three tables."""
    kinds = {
        **dict.fromkeys(("descripcion", "codigo", "unidad", "unidadCruda", "capitulo", "articulo", "clasificacion", "motivo", "componente", "codigoInsumo"), "t"),
        **dict.fromkeys((*COMPONENTES, "costoDirecto", "cantidad", "precioUnitario", "subtotal", "porcentaje", "base", "distancia", "jornal", "factorPrestacional"), "d"),
        "sinResolver": "n", "fila": "n",
    }
    return f"'{tabla}' AS tabla, archivo, hoja, " + ", ".join(f"{own.get(c, _NONE[k])} AS {c}" for c, k in kinds.items())


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_LINES = (
    f"SELECT s.*, NULL::DOUBLE AS porcentaje, NULL::DOUBLE AS base FROM ({SECTION}) s UNION ALL "
    f"SELECT archivo, hoja, fila, componente, codigo, 'HERRAMIENTA MENOR', unidad, cantidad, precioUnitario, NULL, NULL, NULL, subtotal, porcentaje, base FROM ({MINOR})"
)


@query(
    "accepted_tables",
    sql(
        "SELECT " + _row("apus", codigo="x.codigo", sinResolver="coalesce(u.n, 0)", **_same("descripcion", "unidad", "unidadCruda", "capitulo", "articulo", "clasificacion", *COMPONENTES, "costoDirecto"))
        + f" FROM ({XREF}) x JOIN (SELECT archivo, hoja, {', '.join(COMPONENTES)} FROM hojas) t USING (archivo, hoja) JOIN {_GOOD} g USING (archivo, hoja) "
        f"LEFT JOIN (SELECT archivo, hoja, count(*) AS n FROM ({UNRESOLVED}) GROUP BY ALL) u USING (archivo, hoja) UNION ALL SELECT "
        + _row("lineas", codigo="replace(hoja,',','.')", codigoInsumo="codigo", unidad=_CANON.format(x="c"), unidadCruda=f"CASE WHEN c<>{_CANON.format(x='c')} THEN c END",
               **_same("descripcion", "fila", "componente", "cantidad", "precioUnitario", "subtotal", "porcentaje", "base", "distancia", "jornal", "factorPrestacional"))
        + f" FROM (SELECT s.*, coalesce(s.unidad, CASE WHEN s.componente='manoDeObra' THEN 'jornal' END, e.u, 'h') AS c FROM ({_LINES}) s LEFT JOIN ({EQUIPMENT}) e ON e.archivo=s.archivo AND e.codigo=s.codigo) "
        f"JOIN {_GOOD} g USING (archivo, hoja) UNION ALL SELECT " + _row("rechazos", motivo="motivo") + f" FROM ({VERDICT}) WHERE motivo IS NOT NULL",
        "hojas", "listado",
    ),
)
def accepted_tables(spark, sf):
    return X.accepted_tables(_defective(T.cells(spark, sf)), WIDE)


@query(
    "reject_files",
    sql(
        f"WITH n AS (SELECT archivo, count(*) AS hojas, count(*) FILTER (WHERE regexp_full_match(hoja, '\\d+(,\\d+)*')) AS items FROM ({SHEETS}) GROUP BY archivo), "
        "f AS (SELECT 'LIBRO_'||CAST(p_partkey//100 AS VARCHAR) AS archivo, bool_or(p_partkey%100=0) AS portada, bool_or(p_partkey%100=4) AS cuarta, bool_or(p_partkey%100=8) AS octava FROM part GROUP BY ALL) "
        "SELECT n.archivo, CASE WHEN hojas<>106 THEN 'estructura: hojas' WHEN items<>99 THEN 'estructura: items' WHEN NOT portada THEN 'estructura: falta' "
        "WHEN right(n.archivo,1)='3' THEN 'portada: sin departamento' WHEN right(n.archivo,1)='4' THEN 'portada: sin provincia' "
        "WHEN right(n.archivo,1)='5' THEN 'índice: sin descripción' WHEN right(n.archivo,1)='6' THEN 'índice: importe no numérico' "
        "WHEN right(n.archivo,1)='7' THEN 'insumos: sin descripción' WHEN right(n.archivo,1)='8' THEN 'insumos: sin unidad' END AS motivo FROM n LEFT JOIN f USING (archivo)",
        "pos",
    ).replace(" WITH n AS", ", n AS", 1),
)
def reject_files(spark, sf):
    """Each kind of fault in the workbooks whose number ends in one digit."""
    last = F.right("archivo", F.lit(1))

    def at(digit, hoja, row=None):
        there = F.col("hoja") == hoja if row is None else (F.col("hoja") == hoja) & (F.col("fila") == row)
        return (last == digit) & there

    gone = {
        "D": at("3", "PORTADA", 24) | at("8", "MATERIALES"), "F": at("4", "PORTADA", 24) | at("5", "ÍNDICE", 9), "CL": at("4", "PORTADA", 24),
        "K": at("6", "ÍNDICE", 9), "E": at("7", "EQUIPO", 7),
    }
    cells = _changed(T.cells(spark, sf), {c: (where, None, None) for c, where in gone.items()})
    return X.reject_files(cells, n_sheets=106, n_items=99, support=("PORTADA",))


@query(
    "clean_cells",
    "SELECT turn, conv_id, nullif(regexp_replace(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')), ' ', chr(10)), '') AS texto FROM conversations",
)
def clean_cells(spark, sf):
    """Each text with its first blank turned into a ragged line break and blanks doubled."""
    flat = F.trim(F.regexp_replace("text", "[ \\t\\n]+", " "))
    ragged = F.concat(F.lit("\u00a0 "), F.regexp_replace(F.regexp_replace(flat, "^([^ ]*) ", "$1 \t\r\n\u00a0 "), "(?<=[^\\s\u00a0]) (?=[^\\s\u00a0])", "  \u00a0"), F.lit("\r\n \t"))
    rows = T.read(spark, sf, "conversations").select("conv_id", "turn", ragged.alias("texto"))
    return clean.clean_cells(rows, "texto")
