"""Data quality: rules as columns, violations as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preciario import constants as C
from preciario.functions.money import exact_units, from_units, sum_money
from preciario.functions.text import trim_all
from preciario.operators.extract import department_name


@dataclass(frozen=True)
class Regla:
    """A named rule; ``falla`` is true on a row that breaks it."""

    nombre: str
    falla: Column
    valor: Column


def violations(df: DataFrame, keys: list[str], rules: list[Regla]) -> DataFrame:
    """One row per broken rule: keys, rule, offending value.  One pass, no shuffle."""
    broken = [
        F.when(
            F.coalesce(r.falla, F.lit(True)),
            F.struct(F.lit(r.nombre).alias("regla"), r.valor.cast("string").alias("valor")),
        )
        for r in rules
    ]
    return df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("v")).select(*keys, "v.*")


def required(column: str) -> Regla:
    return Regla(f"{column}: obligatorio", trim_all(F.coalesce(F.col(column), F.lit(""))) == "", F.col(column))


def not_blank(column: str) -> Regla:
    """Optional text: may be absent, may not be blank."""
    return Regla(f"{column}: vacío", F.coalesce(trim_all(F.col(column)) == "", F.lit(False)), F.col(column))


def matches(column: str, pattern: str) -> Regla:
    return Regla(f"{column}: formato", ~F.coalesce(F.col(column), F.lit("")).rlike(pattern), F.col(column))


def non_negative(column: str, optional: bool = False) -> Regla:
    bad = F.col(column).isNull() | F.isnan(F.col(column).cast("double")) | (F.col(column) < 0)
    if optional:
        bad = F.col(column).isNotNull() & bad
    return Regla(f"{column}: negativo", bad, F.col(column))


def one_of(column: str, values: tuple[str, ...]) -> Regla:
    return Regla(f"{column}: desconocido", ~F.coalesce(F.col(column), F.lit("")).isin(*values), F.col(column))


def when_present(rule: Regla, column: str) -> Regla:
    return Regla(rule.nombre, F.col(column).isNotNull() & rule.falla, rule.valor)


def apu_rules() -> list[Regla]:
    return [
        matches("codigo", C.PATRON_CODIGO),
        matches("vigencia", C.PATRON_VIGENCIA),
        *(required(c) for c in ("descripcion", "unidad")),
        *(not_blank(c) for c in ("unidadCruda", "capituloNombre", "articulo", "clasificacion", "notaFuente")),
        *(non_negative(c) for c in (*C.COMPONENTES, "costoDirecto")),
        Regla("lineas: al menos una", F.coalesce(F.col("nLineas"), F.lit(0)) < 1, F.col("nLineas")),
        Regla("vigencia: distinta de la procedencia", F.col("vigencia") != F.col("procedenciaVigencia"), F.col("procedenciaVigencia")),
    ]


def line_rules() -> list[Regla]:
    return [
        one_of("componente", C.COMPONENTES),
        *(required(c) for c in ("descripcion", "unidad")),
        *(non_negative(c) for c in ("cantidad", "precioUnitario", "subtotal")),
        *(non_negative(c, optional=True) for c in ("porcentaje", "base", "distancia", "jornal", "factorPrestacional")),
    ]


def region_rules() -> list[Regla]:
    return [
        matches("regionCodigo", C.PATRON_REGION),
        Regla("regionCodigoDane: desconocido", department_name(F.col("regionCodigoDane")).isNull(), F.col("regionCodigoDane")),
        *(required(c) for c in ("departamento", "provincia")),
        matches("slug", C.PATRON_SLUG),
        Regla(
            "regionCodigoDane: no es prefijo", F.substring("regionCodigo", 1, 2) != F.col("regionCodigoDane"), F.col("regionCodigoDane")
        ),
    ]


def supply_rules(list_region: str | None = None) -> list[Regla]:
    rules = [
        one_of("componente", C.COMPONENTES),
        *(required(c) for c in ("descripcion", "unidad")),
        *(not_blank(c) for c in ("codigoInsumo", "unidadCruda", "categoria")),
        non_negative("precio"),
        non_negative("factorPrestacional", optional=True),
    ]
    if list_region:
        rules.append(Regla("region: ajena a la lista", F.col("regionCodigo") != F.col(list_region), F.col("regionCodigo")))
    return rules


def catalog_rules() -> list[Regla]:
    return [
        matches("codigo", C.PATRON_CODIGO),
        *(required(c) for c in ("descripcion", "unidad")),
        matches("capitulo", C.PATRON_CAPITULO),
        when_present(Regla("capituloNumero: no positivo", F.col("capituloNumero") < 1, F.col("capituloNumero")), "capituloNumero"),
        *(not_blank(c) for c in ("unidadCruda", "capituloNombre", "clasificacion")),
        *(non_negative(c) for c in ("min", "max", "mediana", "promedio", "conDato")),
    ]


def header_rules() -> list[Regla]:
    """Rules of the head of every published document."""
    return [
        Regla("schemaVersion: desconocida", F.coalesce(F.col("schemaVersion"), F.lit("")) != C.SCHEMA_VERSION, F.col("schemaVersion")),
        matches("vigencia", C.PATRON_VIGENCIA),
        *(required(c) for c in ("generadoPor", "nota")),
        Regla("procedencia: obligatoria", F.col("procedencia").isNull(), F.lit(None).cast("string")),
    ]


def _none_of(column: str, name: str, bad) -> Regla:
    """No element of an array may be bad; the value is the number of those that are."""
    wrong = F.size(F.filter(F.coalesce(F.col(column), F.array()), lambda x: F.coalesce(bad(x), F.lit(True))))
    return Regla(f"{column}: {name}", wrong > 0, wrong)


def _at_least_one(column: str) -> Regla:
    return Regla(f"{column}: al menos uno", F.coalesce(F.size(column), F.lit(0)) < 1, F.lit(None).cast("string"))


def item_rules() -> list[Regla]:
    """Rules of an item document, head included."""
    amounts = [f"agregados.{c}" for c in ("min", "max", "mediana", "promedio")]
    return [
        *header_rules(),
        matches("codigo", C.PATRON_CODIGO),
        *(required(c) for c in ("descripcion", "unidad")),
        matches("capitulo", C.PATRON_CAPITULO),
        when_present(Regla("capituloNumero: no positivo", F.col("capituloNumero") < 1, F.col("capituloNumero")), "capituloNumero"),
        *(not_blank(c) for c in ("unidadCruda", "capituloNombre", "articulo", "clasificacion", "notaFuente")),
        *(non_negative(c) for c in (*amounts, "provinciasConDato")),
        _at_least_one("regiones"),
        _none_of("regiones", "slug", lambda r: ~r["region"]["slug"].rlike(C.PATRON_SLUG)),
        _none_of("regiones", "costo negativo", lambda r: r["costoDirecto"] < 0),
        *(_none_of("regiones", f"{c} negativo", lambda r, c=c: r["totales"][c] < 0) for c in C.COMPONENTES),
    ]


def province_item_rules() -> list[Regla]:
    """Rules of a province document's item list."""
    return [
        _at_least_one("items"),
        _none_of("items", "codigo", lambda i: ~i["codigo"].rlike(C.PATRON_CODIGO)),
        _none_of("items", "titulo", lambda i: trim_all(i["titulo"]) == ""),
        _none_of("items", "capitulo", lambda i: ~i["capitulo"].rlike(C.PATRON_CAPITULO)),
        _none_of("items", "costo negativo", lambda i: i["costoDirecto"] < 0),
    ]


def stats_document_rules() -> list[Regla]:
    """Rules of the statistics document: head, counts, arrays, extremes."""
    counts = ("items", "provincias", "departamentos", "apus", "lineas", "insumos", "lineasSinResolver")
    return [
        *header_rules(),
        *(non_negative(f"conteos.{c}") for c in counts),
        *(non_negative(f"costoDirecto.{c}") for c in ("min", "max", "mediana", "promedio")),
        *(_at_least_one(c) for c in ("capitulos", "departamentos")),
        _none_of("capitulos", "capitulo", lambda x: ~x["capitulo"].rlike(C.PATRON_CAPITULO)),
        _none_of("capitulos", "sin ítems", lambda x: x["items"] < 1),
        _none_of("capitulosInvias", "número", lambda x: x["numero"] < 1),
        _none_of("capitulosInvias", "nombre", lambda x: trim_all(x["nombre"]) == ""),
        _none_of("capitulosInvias", "sin ítems", lambda x: x["items"] < 1),
        _none_of("departamentos", "código", lambda x: ~x["codigoDane"].rlike(C.PATRON_DANE)),
        _none_of("departamentos", "sin provincias", lambda x: x["provincias"] < 1),
        *(matches(f"notables.{e}.slug", C.PATRON_SLUG) for e in ("provinciaMasCara", "provinciaMasBarata")),
        *(non_negative(f"notables.{e}.medianaCostoDirecto") for e in ("provinciaMasCara", "provinciaMasBarata")),
    ]


def province_rules() -> list[Regla]:
    return [*region_rules(), *(non_negative(c) for c in ("min", "max", "mediana", "promedio", "itemsConDato"))]


def stats_rules() -> list[Regla]:
    names = ("items", "provincias", "departamentos", "apus", "lineas", "insumos", "lineasSinResolver")
    return [non_negative(c) for c in names]


def provenance_rules() -> list[Regla]:
    date = F.coalesce(F.col("fechaDescarga"), F.lit(""))
    return [
        required("fuente"),
        Regla("url: formato", ~F.coalesce(F.col("url"), F.lit("")).rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:\S+\z"), F.col("url")),
        matches("vigencia", C.PATRON_VIGENCIA),
        Regla(
            "fechaDescarga: fecha", ~date.rlike(C.PATRON_FECHA) | F.try_to_date(date, "yyyy-MM-dd").isNull(), F.col("fechaDescarga")
        ),
        required("licencia"),
    ]


def _one(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: check(x)


def _unknown(document: Column, allowed: T.StructType, prefix: str = "") -> Column:
    """Paths of a JSON object's fields that the schema does not know, at every level."""
    keys = F.json_object_keys(document)
    extra = F.array_except(keys, F.array(*(F.lit(f.name) for f in allowed)))
    found = [F.transform(extra, lambda k: F.concat(F.lit(prefix), k))]
    for f in allowed:
        inner = F.get_json_object(document, f"$.{f.name}")
        if isinstance(f.dataType, T.StructType):
            found.append(_unknown(inner, f.dataType, f"{prefix}{f.name}."))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            check = partial(_unknown, allowed=f.dataType.elementType, prefix=f"{prefix}{f.name}[].")
            found.append(F.flatten(F.transform(F.from_json(inner, "array<string>"), _one(check))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(x, none) for x in found))))


def unknown_fields(raw: DataFrame, column: str, allowed: T.StructType) -> DataFrame:
    """JSON fields the schema does not know, one row per path; fields of nested
    objects and of array elements are checked as well.  A text that is no JSON
    object is reported as such."""
    whole = F.json_object_keys(column).isNotNull()
    found = F.when(whole, _unknown(F.col(column), allowed)).otherwise(F.array(F.lit("(no es un objeto)")))
    return raw.select(*[c for c in raw.columns if c != column], F.explode(found).alias("campo"))


def coherence(facts: DataFrame, lines: DataFrame, tolerance: float = C.TOLERANCIA) -> DataFrame:
    """Component totals against the sum of their lines, and direct cost against
    the sum of the components; only gaps above the tolerance."""
    keys = ["codigo", "slug"]
    sums = lines.groupBy(*keys, "componente").agg(sum_money(F.col("subtotal")).alias("hallado"))
    declared = facts.unpivot(keys, list(C.COMPONENTES), "componente", "declarado")
    parts = declared.join(sums, [*keys, "componente"], "left").select(
        *keys, F.col("componente").alias("regla"), "declarado", F.coalesce("hallado", F.lit(0.0)).alias("hallado")
    )
    total = from_units(reduce(lambda a, b: a + b, (exact_units(F.col(c)) for c in C.COMPONENTES)))
    whole = facts.select(*keys, F.lit("costoDirecto").alias("regla"), F.col("costoDirecto").alias("declarado"), total.alias("hallado"))
    return parts.unionByName(whole).where(F.abs(F.col("hallado") - F.col("declarado")) > tolerance)


def cost_vs_index(headers: DataFrame, tolerance: float = C.TOLERANCIA_ESTRICTA) -> DataFrame:
    """Sheets whose cost differs from the one the index gives."""
    gap = F.abs(F.col("costoIndice") - F.col("costoDirecto"))
    return headers.where(F.col("costoIndice").isNotNull() & (gap > tolerance)).withColumn("desvio", gap)


def breakdown_gap(breakdown: DataFrame, facts: DataFrame, tolerance: float = C.TOLERANCIA_ESTRICTA) -> DataFrame:
    """Breakdown totals that do not match the published cost; nothing is adjusted."""
    totals = breakdown.select("codigo", "slug", "total").distinct()
    joined = totals.join(facts.select("codigo", "slug", "costoDirecto"), ["codigo", "slug"])
    gap = F.abs(F.col("total") - F.col("costoDirecto"))
    return joined.where(gap > tolerance).withColumn("descuadre", gap)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


#: Buckets of keys on each level of a comparison by digests.
DIGEST_BUCKETS, DIGEST_LEVELS = 4096, 2


def _digests(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with the hash of their key and two of all their values, nulls told apart from each other."""
    values = [x for c in (*keys, *columns) for x in (F.col(c).isNull(), F.col(c))]
    return df.withColumns({"_k": F.xxhash64(*(x for c in keys for x in (F.col(c).isNull(), F.col(c)))), "_h": F.xxhash64(F.lit(1), *values), "_g": F.xxhash64(F.lit(2), *values)})


def differing(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that can differ.

    Keys are dealt into buckets, and a bucket has one digest: number of rows and sums of their hashes, whatever their order.
    Buckets of equal digests are equal; those that are not are cut into buckets again.  Only numbers are exchanged, at most
    ``DIGEST_BUCKETS`` a task, so equal tables are compared without a row moving.
    """
    sides = [_digests(df, keys, columns) for df in (left, right)]
    for level in range(DIGEST_LEVELS):
        path = F.struct(*(F.pmod(F.expr(f"_k div {DIGEST_BUCKETS**i}"), F.lit(DIGEST_BUCKETS)).alias(f"b{i}") for i in range(level + 1))).alias("_b")
        sums = [
            side.groupBy(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("h"), F.sum(F.col("_g").cast("decimal(20,0)")).alias("g"))
            for side in sides
        ]
        merged = sums[0].join(sums[1].withColumnsRenamed({"n": "m", "h": "i", "g": "j"}), "_b", "full_outer")
        same = F.col("n").eqNullSafe(F.col("m")) & F.col("h").eqNullSafe(F.col("i")) & F.col("g").eqNullSafe(F.col("j"))
        open_ = merged.where(~same).select("_b")
        sides = [side.withColumn("_b", path).join(open_, "_b", "left_semi").drop("_b") for side in sides]
    return tuple(side.drop("_k", "_h", "_g") for side in sides)


def golden_diff(actual: DataFrame, expected: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values that differ from a stored expectation, missing rows included; only rows of buckets that differ are joined."""
    actual, expected = differing(actual.select(*keys, *columns), expected.select(*keys, *columns), keys, columns)
    left = actual.select(*keys, F.struct(*columns).alias("_a"))
    right = expected.select(*keys, F.struct(*columns).alias("_e"))
    joined = left.join(right, keys, "full_outer")
    side = F.when(F.col("_e").isNull(), "sobra").when(F.col("_a").isNull(), "falta").otherwise("difiere")
    checks = [
        F.when(
            ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_e.{c}")),
            F.struct(
                F.lit(c).alias("columna"),
                F.col(f"_e.{c}").cast("string").alias("esperado"),
                F.col(f"_a.{c}").cast("string").alias("hallado"),
            ),
        )
        for c in columns
    ]
    return joined.select(*keys, side.alias("lado"), F.explode(F.array_compact(F.array(*checks))).alias("d")).select(*keys, "lado", "d.*")
