"""The unit-cost tables, derived from the driver's star schema.

``lines``      one row per priced line of an item in a region
``facts``      one row per item and region: component totals and direct cost
``supplies``   one row per supply and region
``*_cells``    the same data as sheet rows, with the text and the number of each column

Only ``lines`` grows without bound.  ``facts`` is unique on (codigo, slug), so
after that aggregation a group by item has at most one row per region and a
group by region at most one row per item.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from preciario.constants import (
    CODIGO_HERRAMIENTA_MENOR,
    COMPONENTES,
    ETIQUETA_COSTO_DIRECTO,
    ETIQUETA_SUBTOTAL,
    VIGENCIA,
)
from preciario.functions.money import sum_money
from preciario.functions.ordering import positions
from preciario.sources.layout import COLUMNAS, LISTADOS, SECCIONES, WIDE_FIRST_ROW

#: Lines are positioned inside tiles of this many consecutive order keys.
ORDERS_PER_TILE = 1 << 20

#: Raw unit spelling, canonical unit for each part type.
UNIT_BY_TYPE = {
    "STANDARD": ("m3", "m3"),
    "ECONOMY": ("Kg", "kg"),
    "MEDIUM": ("m3 - Km", "m3-km"),
    "PROMO": ("Global", "Global"),
    "LARGE": ("m³", "m3"),
    "SMALL": ("HA", "ha"),
}

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; its footer is asked for the schema once in a session, which otherwise costs a job for every read."""
    path = f"{sf_dir}/{table}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def raw_unit(p_type: Column, index: int = 0) -> Column:
    out = F.lit(None).cast("string")
    for name, pair in UNIT_BY_TYPE.items():
        out = F.when(p_type == name, F.lit(pair[index])).otherwise(out)
    return out


def unit_columns(p_type: Column) -> dict[str, Column]:
    raw, canonical = raw_unit(p_type, 0), raw_unit(p_type, 1)
    return {"unidad": canonical, "unidadCruda": F.when(raw != canonical, raw)}


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region dimension; its size is that of ``nation``."""
    dane = F.lpad((F.col("r_regionkey") * 3 + 5).cast("string"), 2, "0")
    return (
        read(spark, sf_dir, "nation")
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("s_nationkey"),
            F.concat(dane, F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("regionCodigo"),
            dane.alias("regionCodigoDane"),
            F.col("r_name").alias("departamento"),
            F.col("n_name").alias("provincia"),
            F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("slug"),
        )
    )


def _component() -> Column:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        F.when(flag == "A", "equipo")
        .when(flag == "N", "materiales")
        .when(status == "F", "transporte")
        .otherwise("manoDeObra")
    )


def cents() -> Column:
    """Line amount (price times discount) in whole cents, half up, all integers."""
    return F.expr("(floor(l_extendedprice * 100 + 0.5) * floor(l_discount * 100 + 0.5) + 50) div 100")


def priced_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Lineitem rows with component, amount, item and region keys.

    Component and amount are computed before the joins, so the raw columns they
    need do not travel through them.  ``columns`` names lineitem columns to keep.
    """
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 9).cast("int").alias("brand"), "p_size"
    )
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return (
        lineitem(spark, sf_dir)
        .withColumns({"componente": _component(), "subtotal": cents() / 100})
        .select("l_partkey", "l_suppkey", "componente", "subtotal", *columns)
        .join(supplier, "l_suppkey")
        .join(part, "l_partkey")
    )


def part_names(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias(key), "p_name", "p_type")


def _item_code() -> dict[str, Column]:
    chapter = (F.lit(200) + (F.col("brand") - 1) * 28).cast("string")
    return {"codigo": F.concat(chapter, F.lit("."), F.col("p_size").cast("string")), "capitulo": chapter}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line table without ``orden``; see :func:`with_order`."""
    componente = F.col("componente")
    labour, haul = componente == "manoDeObra", componente == "transporte"
    return (
        priced_lines(
            spark, sf_dir, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_shipdate"
        )
        .join(part_names(spark, sf_dir, "l_partkey"), "l_partkey")
        .join(regions(spark, sf_dir), "s_nationkey")
        .withColumns(_item_code())
        .withColumns(unit_columns(F.col("p_type")))
        .select(
            F.lit(VIGENCIA).alias("vigencia"),
            "regionCodigo",
            "slug",
            "departamento",
            "provincia",
            "codigo",
            "componente",
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("codigoInsumo"),
            F.col("p_name").alias("descripcion"),
            "unidad",
            "unidadCruda",
            F.col("l_quantity").alias("cantidad"),
            F.col("l_extendedprice").alias("precioUnitario"),
            "subtotal",
            F.lit(None).cast("double").alias("porcentaje"),
            F.lit(None).cast("double").alias("base"),
            F.when(haul, F.lit(1.0)).alias("distancia"),
            F.when(labour, F.col("l_extendedprice")).alias("jornal"),
            F.when(labour, F.lit(1.0) + F.col("l_tax")).alias("factorPrestacional"),
            *LINE_ORDER,
            "l_tax",
            "l_shipdate",
            "capitulo",
        )
    )


def with_order(line_table: DataFrame) -> DataFrame:
    """Add ``orden``, the position of a line inside its item and region."""
    tile = F.expr(f"l_orderkey div {ORDERS_PER_TILE}")
    return positions(line_table, ["codigo", "slug"], LINE_ORDER, tile).withColumn("orden", F.col("orden").cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-by-region table with the 22 published columns.

    Lines are grouped on three integers, keeping only numbers, so the partial
    aggregate is a plain hash aggregate; names are joined to the result.
    """
    sums = [
        F.coalesce(sum_money(F.when(F.col("componente") == c, F.col("subtotal"))), F.lit(0.0)).alias(c)
        for c in COMPONENTES
    ]
    grouped = (
        priced_lines(spark, sf_dir)
        .groupBy("brand", "p_size", "s_nationkey")
        .agg(
            *sums,
            sum_money(F.col("subtotal")).alias("costoDirecto"),
            F.min("l_partkey").alias("head"),
        )
    )
    known = F.col("brand") % 5 != 0
    first_digit = F.substring("capitulo", 1, 1).cast("int")
    return (
        grouped.join(part_names(spark, sf_dir, "head"), "head")
        .join(regions(spark, sf_dir), "s_nationkey")
        .withColumns(_item_code())
        .withColumns(unit_columns(F.col("p_type")))
        .select(
            F.lit(VIGENCIA).alias("vigencia"),
            F.concat(
                F.lit("APU_"), "regionCodigo", F.lit("_"), "departamento", F.lit("__"), "provincia", F.lit("_2026_1.xlsx")
            ).alias("archivo"),
            "regionCodigo",
            "regionCodigoDane",
            "departamento",
            "provincia",
            "slug",
            "codigo",
            "capitulo",
            F.when(known, first_digit).alias("capituloNumero"),
            F.when(known, F.concat(F.lit("Grupo "), first_digit.cast("string"), F.lit("-"), (F.col("brand") % 3).cast("string"))).alias(
                "capituloNombre"
            ),
            F.concat(F.lit("Artículo "), "capitulo", F.lit(" - 22")).alias("articulo"),
            F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("clasificacion"),
            F.concat(F.col("p_name"), F.lit("\n("), F.col("p_type"), F.lit(")")).alias("descripcion"),
            "unidad",
            "unidadCruda",
            *COMPONENTES,
            "costoDirecto",
            F.lit(None).cast("string").alias("notaFuente"),
        )
    )


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply-by-region table with the 13 published columns.

    A supply is priced 0 ("not applicable") where no line of it carries tax.
    """
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    seen = (
        lineitem(spark, sf_dir)
        .select("l_partkey", "l_suppkey", "l_tax")
        .join(supplier, "l_suppkey")
        .groupBy("l_partkey", "s_nationkey")
        .agg(F.max("l_tax").alias("tax"))
    )
    part = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    componente = F.element_at(F.array(*map(F.lit, COMPONENTES)), (F.col("p_size") % 4 + 1).cast("int"))
    return (
        seen.join(part, "l_partkey")
        .join(regions(spark, sf_dir), "s_nationkey")
        .withColumns(unit_columns(F.col("p_type")))
        .withColumn("componente", componente)
        .select(
            F.lit(VIGENCIA).alias("vigencia"),
            "regionCodigo",
            "slug",
            "departamento",
            "provincia",
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("codigoInsumo"),
            "componente",
            F.col("p_name").alias("descripcion"),
            "unidad",
            "unidadCruda",
            F.col("p_type").alias("categoria"),
            F.when(F.col("tax") > 0, F.col("p_retailprice")).otherwise(F.lit(0.0)).alias("precio"),
            F.when(F.col("componente") == "manoDeObra", F.lit(2.05)).alias("factorPrestacional"),
        )
    )


# ---------------------------------------------------------------- cells
# A block of 100 parts is a workbook, a part is an item sheet, and each of its
# lineitem rows is one sheet row, counted from WIDE_FIRST_ROW.


def _address(partkey: str) -> dict[str, Column]:
    return {
        "archivo": F.concat(F.lit("LIBRO_"), F.expr(f"{partkey} div 100").cast("string")),
        "hoja": F.concat(
            (F.lit(200) + F.col(partkey) % 700).cast("string"), F.lit(","), F.expr(f"{partkey} div 700").cast("string")
        ),
    }


Cell = tuple[str, Column, Column]


def _cell(columna: str, texto: Column | None = None, numero: Column | None = None) -> Cell:
    blank = F.lit(None)
    return columna, (blank if texto is None else texto).cast("string"), (blank if numero is None else numero).cast("double")


def _filled(cells: list[Cell]) -> Column:
    """Whether a row has a cell that is not blank."""
    return reduce(lambda a, b: a | b, (texto.isNotNull() | numero.isNotNull() for _, texto, numero in cells))


def _parts(cells: list[Cell], columns: Iterable[str] = COLUMNAS) -> list[Column]:
    """Text and number of each column (``B_t``, ``B_n``); blank cells have neither.  A reader computes those it reads."""
    own = {columna: cell for columna, *cell in cells}
    return [x.alias(f"{c}_{part}") for c in columns for x, part in zip(own.get(c) or _cell(c)[1:], "tn", strict=True)]


def _emit(df: DataFrame, fila: Column, cells: list[Cell]) -> DataFrame:
    """One sheet row for each row of ``df``; those without a cell are absent."""
    return df.where(_filled(cells)).select("archivo", "hoja", fila.cast("long").alias("fila"), *_parts(cells))


def _emit_rows(df: DataFrame, cells: list[tuple[int, str, Column | None, Column | None]]) -> DataFrame:
    """Several sheet rows, by number, for each row of ``df``; those without a cell are absent."""
    by_row: dict[int, list[Cell]] = {}
    for fila, *cell in cells:
        by_row.setdefault(fila, []).append(_cell(*cell))
    columns = [c for c in COLUMNAS if any(c == x[1] for x in cells)]
    made = [F.when(_filled(own), F.struct(F.lit(fila).cast("long").alias("fila"), *_parts(own, columns))) for fila, own in by_row.items()]
    kept = F.filter(F.array(*made), lambda r: r.isNotNull())
    rows = df.select("archivo", "hoja", F.explode(kept).alias("r"))
    return rows.select("archivo", "hoja", "r.fila", *_parts([(c, F.col(f"r.{c}_t"), F.col(f"r.{c}_n")) for c in columns]))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows with their sheet address."""
    tile = F.expr(f"l_orderkey div {ORDERS_PER_TILE}")
    placed = positions(
        lineitem(spark, sf_dir).select(
            "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"
        ),
        ["l_partkey"],
        ["l_orderkey", "l_linenumber", "l_suppkey"],
        tile,
        name="posicion",
    )
    p = F.col("posicion")
    componente = F.when(p <= 2, "equipo").when(p <= 4, "materiales").when(p <= 6, "transporte").otherwise("manoDeObra")
    return placed.withColumns(_address("l_partkey")).withColumns({"componente": componente, "subtotal": cents() / 100})


def _line_row() -> tuple[Column, list[Cell]]:
    """Number and cells of a line row; a code is blank without tax, an amount without discount.  Every fourth supplier's code is a long number."""
    numeric = F.col("l_suppkey") % 4 == 0
    fila = F.col("posicion") + (WIDE_FIRST_ROW - 1)
    kind = F.col("componente")
    unit = F.when(F.col("l_linestatus") == "F", "m3 - Km").when(F.col("l_quantity") > 10, "Kg")
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")

    def only(*names: str):
        return lambda value: F.when(kind.isin(*names), value)

    equipo, materiales = only("equipo"), only("materiales")
    transporte, labour = only("transporte"), only("manoDeObra")
    cells = [
        _cell("B", F.when((F.col("l_tax") > 0) & ~numeric, F.concat(F.lit("P"), F.col("l_suppkey").cast("string"))), F.when((F.col("l_tax") > 0) & numeric, F.col("l_suppkey") + 10_000_000)),
        _cell("C", F.concat(F.lit("INSUMO "), F.col("l_suppkey").cast("string"))),
        _cell("I", transporte(unit), labour(price)),
        _cell("J", materiales(unit), F.coalesce(transporte(quantity), labour(F.lit(1.0) + F.col("l_tax")))),
        _cell("K", None, F.coalesce(equipo(price), materiales(quantity), transporte(F.lit(1.0)), labour(price * 2))),
        _cell("L", None, F.coalesce(equipo(quantity), materiales(price), labour(quantity))),
        _cell("M", None, transporte(price)),
        _cell("N", None, F.when(F.col("l_discount") > 0, F.col("subtotal"))),
    ]
    return fila, cells


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line rows of the sheets."""
    return _emit(sheet_rows(spark, sf_dir), *_line_row())


def sheet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section subtotals of each sheet, from its resolved lines."""
    resolved = (F.col("l_tax") > 0) & (F.col("l_discount") > 0)
    # asks for what only the line rows read, so that both take one exchange of lineitem; every row has a position
    every = (F.col("posicion") > 0) | F.col("l_quantity").isNotNull() | F.col("l_linestatus").isNotNull()
    return (
        sheet_rows(spark, sf_dir)
        .where(every)
        .groupBy("l_partkey")
        .agg(
            *(
                F.coalesce(sum_money(F.when(resolved & (F.col("componente") == c), F.col("subtotal"))), F.lit(0.0)).alias(c)
                for c in COMPONENTES
            ),
            F.coalesce(sum_money(F.when(resolved, F.col("subtotal"))), F.lit(0.0)).alias("total"),
        )
    )


def header_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cells of the item sheets.

    Some sheets break the form on purpose: a wrong banner (key % 11 = 0), a
    missing subtotal label (key % 13 = 0), an overhead value (key % 17 = 0), a
    non-numeric subtotal (key % 19 = 0) and a drifted code (key % 23 = 0).
    """
    key = F.col("l_partkey")
    rows = sheet_totals(spark, sf_dir).withColumns(_address("l_partkey"))

    code = F.when(key % 23 == 0, F.lit("999,9")).otherwise(F.replace("hoja", F.lit(","), F.lit(".")))
    cells = [
        (33, "B", code, None),
        (33, "C", F.concat(F.lit("ITEM "), key.cast("string")), None),
        (33, "L", F.when(key % 2 == 0, "m3 - Km").when(key % 3 == 0, "Kg"), None),
        (101, "B", F.lit(ETIQUETA_COSTO_DIRECTO), None),
        (101, "N", None, F.col("total")),
        (109, "N", None, F.when(key % 17 == 0, F.col("total") * 0.2)),
        (52, "B", F.when(key % 3 == 0, F.lit(CODIGO_HERRAMIENTA_MENOR)), None),
        (52, "C", F.when(key % 3 == 0, F.lit("HERRAMIENTA MENOR")), None),
        (52, "K", None, F.when(key % 3 == 0, F.col("manoDeObra"))),
        (52, "L", None, F.when(key % 3 == 0, F.lit(0.05))),
        (52, "N", None, F.when(key % 3 == 0, F.floor(F.col("manoDeObra") * 0.05 * 100 + 0.5) / 100)),
    ]
    for section in SECCIONES:
        text = F.lit(section.texto_banner)
        if section.componente == "equipo":
            text = F.when(key % 11 == 0, "I. OTRA COSA").otherwise(F.lower(text))
        label = F.lit(ETIQUETA_SUBTOTAL)
        if section.componente == "materiales":
            label = F.when(key % 13 != 0, label)
        value = F.col(section.componente)
        bad = (key % 19 == 0) if section.componente == "transporte" else F.lit(False)
        cells += [
            (section.banner_row, "B", text, None),
            (section.subtotal_row, "B", label, None),
            (section.subtotal_row, "N", F.when(bad, "#N/A"), F.when(~bad, value)),
        ]
    return _emit_rows(rows, cells)


def index_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index sheet of each workbook: one row per part; row 5 + 37 has no code, row 5 + 30 lists the code before it once more."""
    key = F.col("p_partkey")
    listed = read(spark, sf_dir, "part").withColumn("listed", F.when(key % 100 == 30, key - 1).otherwise(key))
    rows = listed.withColumns(_address("listed")).withColumnRenamed("hoja", "sheet").withColumn("hoja", F.lit("ÍNDICE"))
    fila = F.lit(5) + key % 100
    price = F.col("p_retailprice")
    return _emit(
        rows,
        fila,
        [
            _cell("A", None, key % 100 + 1),
            _cell("B", F.concat(F.lit("Capitulo "), (F.col("p_size") % 8 + 2).cast("string"), F.lit("\nGrupo "), "p_type")),
            _cell("C", F.concat(F.lit("Artículo "), "p_brand")),
            _cell("D", F.when(key % 4 != 0, F.lit("GENERAL"))),
            _cell("E", F.when(key % 100 != 37, F.when(key % 5 == 0, F.replace("sheet", F.lit(","), F.lit("."))).otherwise(F.col("sheet")))),
            _cell("F", F.col("p_name")),
            _cell("G", raw_unit(F.col("p_type"))),
            _cell("H", None, price),
            _cell("I", None, price * 2),
            _cell("J", None, F.lit(0.0)),
            _cell("K", None, price),
            _cell("L", None, price * 4),
        ],
    )


def listing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four supply listings of each workbook, plus the salary block."""
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").withColumns(_address("p_partkey"))
    out = None
    for index, listing in enumerate(LISTADOS):
        fila = F.lit(listing.first_row) + F.expr("(p_partkey % 100) div 4")
        values = {
            "codigo": (F.when(key % 100 < 88, F.concat(F.lit("P"), key.cast("string"))), None),
            "descripcion": (F.col("p_name"), None),
            "unidad": (raw_unit(F.col("p_type")), None),
            "precio": (None, F.when(F.col("p_size") % 7 == 0, 0.0).when(F.col("p_size") % 5 != 0, F.col("p_retailprice"))),
            "categoria": (F.col("p_type"), None),
            "factorPrestacional": (None, F.lit(2.0) + F.col("p_size") / 100),
        }
        sheet = rows.where(key % 4 == index).withColumn("hoja", F.lit(listing.hoja))
        cells = [_cell(column, *values[field]) for field, column in listing.columns.items()]
        part = _emit(sheet, fila, cells)
        out = part if out is None else out.unionByName(part)
    salary_row = F.lit(4) + key % 100
    salary = _emit(
        rows.where(key % 100 < 4).withColumn("hoja", F.lit("MANO DE OBRA")),
        salary_row,
        [
            _cell("B", F.lit("COP")),
            _cell("D", F.concat(F.lit("Concepto "), (key % 100).cast("string"))),
            _cell("G", F.when(key % 100 == 2, "n/d"), F.when(key % 100 != 2, F.col("p_retailprice"))),
        ],
    )
    return out.unionByName(salary)


def cover_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover sheet of each workbook; half write the province in the second cell."""
    key = F.col("p_partkey")
    block = F.expr("p_partkey div 100")
    rows = (
        read(spark, sf_dir, "part").where(key % 100 == 0).withColumns(_address("p_partkey")).withColumn("hoja", F.lit("PORTADA"))
    )
    name = F.concat(F.lit("VALLE_DE_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return _emit_rows(
        rows,
        [
            (24, "D", F.lit("NORTE  DE SANTANDER"), None),
            (24, "F", F.when(block % 2 == 0, name), None),
            (24, "CL", F.when(block % 2 == 1, name), None),
            (24, "G", F.lit("42 HORAS"), None),
            (27, "D", None, F.col("p_size") * 10),
            (27, "E", None, F.lit(1.0) + F.col("p_size") / 100),
            (27, "F", None, F.lit(30) - F.col("p_size") / 5),
            (27, "G", F.when(block % 3 == 0, "n/d"), F.when(block % 3 != 0, F.lit(1.02))),
        ],
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets in rows, as their XML has them: archivo, hoja, fila and the text and number of that row's cell in each column."""
    return (
        line_cells(spark, sf_dir)
        .unionByName(header_cells(spark, sf_dir))
        .unionByName(index_cells(spark, sf_dir))
        .unionByName(listing_cells(spark, sf_dir))
        .unionByName(cover_cells(spark, sf_dir))
    )
