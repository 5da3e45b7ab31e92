"""DuckDB statements of the tables, to check the Spark queries against."""

from __future__ import annotations

from preciario.constants import COMPONENTES


def money(x: str) -> str:
    return f"(floor(({x})*100+0.5)/100)"


def exact(x: str, where: str | None = None) -> str:
    cond = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum(CAST({x} AS DECIMAL(20,4))){cond} AS DOUBLE)"


def med(x: str, where: str | None = None) -> str:
    """Median as the mean of the two middle values."""
    cond = f" FILTER (WHERE {where})" if where else f" FILTER (WHERE {x} IS NOT NULL)"
    s = f"list_sort(list({x}){cond})"
    return f"(({s}[(len({s})+1)//2] + {s}[(len({s})+2)//2])/2)"


def natural(x: str) -> str:
    return f"list_transform(string_split({x},'.'), lambda p: CAST(p AS BIGINT))"


def stats(x: str = "costoDirecto") -> str:
    pos = f"{x}>0"
    return (
        f"coalesce({money(f'min({x}) FILTER (WHERE {pos})')},0) AS min, "
        f"coalesce({money(f'max({x}) FILTER (WHERE {pos})')},0) AS max, "
        f"coalesce({money(med(x, pos))},0) AS mediana, "
        f"coalesce({money(exact(x, pos) + f'/count(*) FILTER (WHERE {pos})')},0) AS promedio, "
        f"count(*) FILTER (WHERE {pos}) AS conDato"
    )


UNIT_RAW = (
    "CASE p_type WHEN 'STANDARD' THEN 'm3' WHEN 'ECONOMY' THEN 'Kg' WHEN 'MEDIUM' THEN 'm3 - Km' "
    "WHEN 'PROMO' THEN 'Global' WHEN 'LARGE' THEN 'm³' WHEN 'SMALL' THEN 'HA' END"
)
UNIT = (
    "CASE p_type WHEN 'STANDARD' THEN 'm3' WHEN 'ECONOMY' THEN 'kg' WHEN 'MEDIUM' THEN 'm3-km' "
    "WHEN 'PROMO' THEN 'Global' WHEN 'LARGE' THEN 'm3' WHEN 'SMALL' THEN 'ha' END"
)
UNIT_DIFF = f"CASE WHEN {UNIT_RAW} <> {UNIT} THEN {UNIT_RAW} END"

_DANE = "lpad(CAST(r_regionkey*3+5 AS VARCHAR),2,'0')"
_AMOUNT = (
    "CAST(round(CAST(l_extendedprice AS DECIMAL(12,2))*CAST(l_discount AS DECIMAL(4,2)),2) AS DECIMAL(16,2))"
)
HEAD = "descripcion, unidad, unidadCruda, capitulo, capituloNumero, capituloNombre, clasificacion"

_SUMS = ", ".join(
    f"CAST(coalesce(sum(subtotal) FILTER (WHERE componente='{c}'),0) AS DOUBLE) AS {c}" for c in COMPONENTES
)


def _address(k: str) -> str:
    return f"'LIBRO_'||CAST({k}//100 AS VARCHAR) AS archivo, CAST(200+{k}%700 AS VARCHAR)||','||CAST({k}//700 AS VARCHAR) AS hoja"


#: name -> (names it needs, body)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "regiones": (
        (),
        f"SELECT n_nationkey, {_DANE}||lpad(CAST(n_nationkey AS VARCHAR),2,'0') AS regionCodigo, {_DANE} AS regionCodigoDane, "
        "r_name AS departamento, n_name AS provincia, lower(replace(n_name,'_','-')) AS slug "
        "FROM nation JOIN region ON n_regionkey=r_regionkey",
    ),
    "lineas": (
        ("regiones",),
        "SELECT '2026-1' AS vigencia, regionCodigo, regionCodigoDane, slug, departamento, provincia, "
        "CAST(200+28*(CAST(substr(p_brand,7) AS INTEGER)-1) AS VARCHAR) AS capitulo, "
        "CAST(200+28*(CAST(substr(p_brand,7) AS INTEGER)-1) AS VARCHAR)||'.'||CAST(p_size AS VARCHAR) AS codigo, "
        "CAST(substr(p_brand,7) AS INTEGER) AS brand, p_name, p_type, "
        "CASE WHEN l_returnflag='A' THEN 'equipo' WHEN l_returnflag='N' THEN 'materiales' WHEN l_linestatus='F' THEN 'transporte' "
        "ELSE 'manoDeObra' END AS componente, 'P'||CAST(l_partkey AS VARCHAR) AS codigoInsumo, p_name AS descripcion, "
        f"{UNIT} AS unidad, {UNIT_DIFF} AS unidadCruda, l_quantity AS cantidad, l_extendedprice AS precioUnitario, "
        f"{_AMOUNT} AS subtotal, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax, l_shipdate "
        "FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey JOIN regiones ON n_nationkey=s_nationkey",
    ),
    "ordenadas": (
        ("lineas",),
        "SELECT *, CAST(row_number() OVER (PARTITION BY codigo, slug ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS orden, "
        "CASE WHEN componente='transporte' THEN 1.0::DOUBLE END AS distancia, CASE WHEN componente='manoDeObra' THEN precioUnitario END AS jornal, "
        "CASE WHEN componente='manoDeObra' THEN 1.0+l_tax END AS factorPrestacional FROM lineas",
    ),
    "apus": (
        ("lineas",),
        "SELECT vigencia, 'APU_'||regionCodigo||'_'||departamento||'__'||provincia||'_2026_1.xlsx' AS archivo, regionCodigo, regionCodigoDane, "
        "departamento, provincia, slug, codigo, capitulo, "
        "CASE WHEN brand%5<>0 THEN CAST(left(capitulo,1) AS INTEGER) END AS capituloNumero, "
        "CASE WHEN brand%5<>0 THEN 'Grupo '||left(capitulo,1)||'-'||CAST(brand%3 AS VARCHAR) END AS capituloNombre, "
        "'Artículo '||capitulo||' - 22' AS articulo, CASE WHEN p_type<>'PROMO' THEN p_type END AS clasificacion, "
        f"p_name||chr(10)||'('||p_type||')' AS descripcion, {UNIT} AS unidad, {UNIT_DIFF} AS unidadCruda, "
        "equipo, materiales, transporte, manoDeObra, costoDirecto, CAST(NULL AS VARCHAR) AS notaFuente FROM ("
        "SELECT vigencia, regionCodigo, regionCodigoDane, departamento, provincia, slug, codigo, capitulo, brand, "
        f"{_SUMS}, CAST(sum(subtotal) AS DOUBLE) AS costoDirecto, arg_min(p_name, l_partkey) AS p_name, arg_min(p_type, l_partkey) AS p_type "
        "FROM lineas GROUP BY ALL)",
    ),
    "cabezas": (("apus",), "SELECT * FROM apus QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY slug)=1"),
    "cat": (
        ("cabezas",),
        f"SELECT codigo, {HEAD}, min, max, mediana, promedio, conDato FROM (SELECT codigo, {stats()} FROM apus GROUP BY codigo) "
        f"JOIN (SELECT codigo, {HEAD} FROM cabezas) USING (codigo)",
    ),
    "prov": (
        ("apus",),
        "SELECT slug, min(regionCodigo) AS regionCodigo, min(regionCodigoDane) AS regionCodigoDane, min(departamento) AS departamento, "
        f"min(provincia) AS provincia, {stats()} FROM apus GROUP BY slug",
    ),
    "cmap": (
        ("cat",),
        "SELECT capitulo, coalesce(capituloNumero, CAST(left(capitulo,1) AS INTEGER)) AS numero, "
        "coalesce(capituloNombre, 'Capítulo '||left(capitulo,1)) AS nombre FROM cat "
        f"QUALIFY row_number() OVER (PARTITION BY capitulo ORDER BY {natural('codigo')})=1",
    ),
    "insumos": (
        ("regiones",),
        "SELECT '2026-1' AS vigencia, regionCodigo, slug, departamento, provincia, 'P'||CAST(l_partkey AS VARCHAR) AS codigoInsumo, "
        "CASE p_size%4 WHEN 0 THEN 'equipo' WHEN 1 THEN 'materiales' WHEN 2 THEN 'transporte' ELSE 'manoDeObra' END AS componente, "
        f"p_name AS descripcion, {UNIT} AS unidad, {UNIT_DIFF} AS unidadCruda, p_type AS categoria, "
        "CASE WHEN tax>0 THEN p_retailprice ELSE 0 END AS precio, CASE WHEN p_size%4=3 THEN 2.05::DOUBLE END AS factorPrestacional "
        "FROM (SELECT l_partkey, s_nationkey, max(l_tax) AS tax FROM lineitem JOIN supplier ON s_suppkey=l_suppkey GROUP BY ALL) "
        "JOIN part ON p_partkey=l_partkey JOIN regiones ON n_nationkey=s_nationkey",
    ),
    "pos": (
        (),
        f"SELECT l_partkey AS k, {_address('l_partkey')}, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS p, "
        f"l_suppkey, l_quantity AS q, l_extendedprice AS pr, l_discount, l_tax, l_linestatus AS ls, {_AMOUNT} AS m FROM lineitem",
    ),
    "filas": (
        ("pos",),
        "SELECT *, 1000+p AS fila, CASE WHEN p<=2 THEN 'equipo' WHEN p<=4 THEN 'materiales' WHEN p<=6 THEN 'transporte' ELSE 'manoDeObra' END AS componente, "
        "CASE WHEN ls='F' THEN 'm3 - Km' WHEN q>10 THEN 'Kg' END AS u, CASE WHEN l_suppkey%4=0 THEN CAST(10000000+l_suppkey AS VARCHAR) ELSE 'P'||CAST(l_suppkey AS VARCHAR) END AS codigo FROM pos",
    ),
    "hojas": (
        ("filas",),
        "SELECT k, archivo, hoja, "
        + ", ".join(
            f"CAST(coalesce(sum(m) FILTER (WHERE componente='{c}' AND l_tax>0 AND l_discount>0),0) AS DOUBLE) AS {c}" for c in COMPONENTES
        )
        + ", CAST(coalesce(sum(m) FILTER (WHERE l_tax>0 AND l_discount>0),0) AS DOUBLE) AS total FROM filas GROUP BY ALL",
    ),
    "indice": (
        (),
        "SELECT p_partkey AS k, " + _address("(p_partkey-CASE WHEN p_partkey%100=30 THEN 1 ELSE 0 END)") + ", 5+p_partkey%100 AS fila, p_partkey%100+1 AS consecutivo, p_name AS descripcion, "
        f"{UNIT} AS unidad, {UNIT_DIFF} AS unidadCruda, 'Capitulo '||CAST(p_size%8+2 AS VARCHAR)||chr(10)||'Grupo '||p_type AS capitulo, "
        "'Artículo '||p_brand AS articulo, CASE WHEN p_partkey%4<>0 THEN 'GENERAL' END AS clasificacion, p_retailprice AS pr "
        "FROM part WHERE p_partkey%100<37",
    ),
    "listado": (("indice",), "SELECT * FROM indice QUALIFY row_number() OVER (PARTITION BY archivo, hoja ORDER BY fila DESC)=1"),
}


def sql(body: str, *tables: str) -> str:
    """Statement with the named tables and whatever they need in front."""
    needed: list[str] = []

    def add(name: str) -> None:
        for parent in TABLES[name][0]:
            add(parent)
        if name not in needed:
            needed.append(name)

    for name in tables:
        add(name)
    if not needed:
        return body
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][1]})" for n in needed) + " " + body
