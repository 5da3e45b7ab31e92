"""Each rule broken once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preciario.operators import quality as Q

APU = {
    "codigo": "630.1.1", "vigencia": "2026-1", "descripcion": "CONCRETO", "unidad": "m3", "unidadCruda": None, "capituloNombre": None,
    "articulo": None, "clasificacion": None, "notaFuente": None, "equipo": 1.0, "materiales": 2.0, "transporte": 0.0, "manoDeObra": 3.0,
    "costoDirecto": 6.0, "nLineas": 4, "procedenciaVigencia": "2026-1",
}
REGION = {"regionCodigo": "0509", "regionCodigoDane": "05", "departamento": "Antioquia", "provincia": "Valle de Aburrá", "slug": "antioquia-valle-de-aburra"}
SUPPLY = {"regionCodigo": "0509", "lista": "0509", "codigoInsumo": "B1", "componente": "equipo", "descripcion": "x", "unidad": "h", "unidadCruda": None, "categoria": None, "precio": 1.5, "factorPrestacional": None}
PROVENANCE = {"fuente": "F", "url": "https://datos.example.org", "vigencia": "2026-1", "fechaDescarga": "2026-02-28", "licencia": "libre"}
LINE = {"componente": "equipo", "descripcion": "x", "unidad": "h", "cantidad": 1.0, "precioUnitario": 1.0, "subtotal": 1.0, "porcentaje": None, "base": None, "distancia": None, "jornal": None, "factorPrestacional": None}
STATS = {c: 1 for c in ("items", "provincias", "departamentos", "apus", "lineas", "insumos", "lineasSinResolver")}
CATALOG = {"codigo": "630.1", "descripcion": "x", "unidad": "m3", "capitulo": "630", "capituloNumero": None, "unidadCruda": None, "capituloNombre": None, "clasificacion": None, "min": 1.0, "max": 2.0, "mediana": 1.0, "promedio": 1.0, "conDato": 2}


def row(spark, base, change):
    def lit(value):
        if value is None:
            return F.lit(None).cast("string")
        return F.lit(value)

    return spark.range(1).select("id", *(lit(v).alias(k) for k, v in {**base, **change}.items()))


CASES = [
    (APU, Q.apu_rules, {}, set()),
    (APU, Q.apu_rules, {"codigo": "630,1"}, {"codigo: formato"}),
    (APU, Q.apu_rules, {"codigo": "63.1"}, {"codigo: formato"}),
    (APU, Q.apu_rules, {"vigencia": "2026-3"}, {"vigencia: formato", "vigencia: distinta de la procedencia"}),
    (APU, Q.apu_rules, {"descripcion": "  "}, {"descripcion: obligatorio"}),
    (APU, Q.apu_rules, {"unidad": None}, {"unidad: obligatorio"}),
    (APU, Q.apu_rules, {"articulo": " "}, {"articulo: vacío"}),
    (APU, Q.apu_rules, {"costoDirecto": -1.0}, {"costoDirecto: negativo"}),
    (APU, Q.apu_rules, {"equipo": float("nan")}, {"equipo: negativo"}),
    (APU, Q.apu_rules, {"nLineas": 0}, {"lineas: al menos una"}),
    (APU, Q.apu_rules, {"procedenciaVigencia": "2025-2"}, {"vigencia: distinta de la procedencia"}),
    (REGION, Q.region_rules, {}, set()),
    (REGION, Q.region_rules, {"regionCodigo": "509"}, {"regionCodigo: formato", "regionCodigoDane: no es prefijo"}),
    (REGION, Q.region_rules, {"regionCodigoDane": "14"}, {"regionCodigoDane: desconocido", "regionCodigoDane: no es prefijo"}),
    (REGION, Q.region_rules, {"slug": "Antioquia"}, {"slug: formato"}),
    (REGION, Q.region_rules, {"slug": "a--b"}, {"slug: formato"}),
    (REGION, Q.region_rules, {"provincia": ""}, {"provincia: obligatorio"}),
    (SUPPLY, lambda: Q.supply_rules("lista"), {}, set()),
    (SUPPLY, lambda: Q.supply_rules("lista"), {"precio": 0.0}, set()),
    (SUPPLY, lambda: Q.supply_rules("lista"), {"precio": -0.1}, {"precio: negativo"}),
    (SUPPLY, lambda: Q.supply_rules("lista"), {"componente": "otro"}, {"componente: desconocido"}),
    (SUPPLY, lambda: Q.supply_rules("lista"), {"lista": "0800"}, {"region: ajena a la lista"}),
    (SUPPLY, lambda: Q.supply_rules("lista"), {"factorPrestacional": -1.0}, {"factorPrestacional: negativo"}),
    (PROVENANCE, Q.provenance_rules, {}, set()),
    (PROVENANCE, Q.provenance_rules, {"url": "datos"}, {"url: formato"}),
    (PROVENANCE, Q.provenance_rules, {"fechaDescarga": "2026-02-30"}, {"fechaDescarga: fecha"}),
    (PROVENANCE, Q.provenance_rules, {"fechaDescarga": "28/02/2026"}, {"fechaDescarga: fecha"}),
    (PROVENANCE, Q.provenance_rules, {"licencia": None}, {"licencia: obligatorio"}),
    (LINE, Q.line_rules, {}, set()),
    (LINE, Q.line_rules, {"cantidad": -1.0}, {"cantidad: negativo"}),
    (LINE, Q.line_rules, {"jornal": -1.0}, {"jornal: negativo"}),
    (STATS, Q.stats_rules, {}, set()),
    (STATS, Q.stats_rules, {"apus": -1}, {"apus: negativo"}),
    (CATALOG, Q.catalog_rules, {}, set()),
    (CATALOG, Q.catalog_rules, {"capitulo": "63"}, {"capitulo: formato"}),
    (CATALOG, Q.catalog_rules, {"capituloNumero": 0}, {"capituloNumero: no positivo"}),
]


@pytest.mark.parametrize("base, rules, change, expected", CASES)
def test_rules(spark, base, rules, change, expected):
    assert {r.regla for r in Q.violations(row(spark, base, change), ["id"], rules()).collect()} == expected


def test_unknown_fields(spark):
    schema = T.StructType([T.StructField("codigo", T.StringType()), T.StructField("costoDirecto", T.DoubleType())])
    raw = spark.createDataFrame([(1, '{"codigo":"x"}'), (2, '{"codigo":"x","aiu":1,"total":2}'), (3, "[]")], "id int, doc string")
    found = sorted(tuple(r) for r in Q.unknown_fields(raw, "doc", schema).collect())
    assert found == [(2, "aiu"), (2, "total"), (3, "(no es un objeto)")]


@pytest.mark.parametrize("tolerance, expected", [(1.0, {("b", "equipo")}), (0.011, {("a", "costoDirecto"), ("b", "equipo")})])
def test_coherence(spark, tolerance, expected):
    facts = spark.createDataFrame(
        [("1", "a", 10.0, 0.0, 0.0, 0.0, 10.5), ("1", "b", 12.0, 0.0, 0.0, 0.0, 12.0)],
        "codigo string, slug string, equipo double, materiales double, transporte double, manoDeObra double, costoDirecto double",
    )
    lines = spark.createDataFrame([("1", "a", "equipo", 10.0), ("1", "b", "equipo", 10.0)], "codigo string, slug string, componente string, subtotal double")
    assert {(r.slug, r.regla) for r in Q.coherence(facts, lines, tolerance).collect()} == expected


def test_golden_diff(spark):
    schema = "codigo string, unidad string, n int"
    actual = spark.createDataFrame([("a", "m3", 1), ("b", None, 2), ("d", "h", 4)], schema)
    expected = spark.createDataFrame([("a", "m3", 1), ("b", "kg", 2), ("c", "h", 3)], schema)
    found = {(r.codigo, r.lado, r.columna, r.esperado, r.hallado) for r in Q.golden_diff(actual, expected, ["codigo"], ["unidad", "n"]).collect()}
    assert found == {
        ("b", "difiere", "unidad", "kg", None), ("c", "falta", "unidad", "h", None), ("c", "falta", "n", "3", None),
        ("d", "sobra", "unidad", None, "h"), ("d", "sobra", "n", None, "4"),
    }


def test_differences_of_large_tables(spark):
    """A few changed, missing and added rows among many equal ones; equal tables leave nothing to join."""
    base = spark.range(30000).select(F.col("id").cast("string").alias("codigo"), F.when(F.col("id") % 7 != 0, F.col("id") % 100).alias("n"), F.lit("u").alias("unidad"))
    other = base.where("codigo <> '77'").withColumn("n", F.when(F.col("codigo") == "123", None).otherwise(F.col("n")))
    other = other.unionByName(spark.createDataFrame([("x", 5, "u")], base.schema)).repartition(5)
    found = {(r.codigo, r.lado, r.columna, r.esperado, r.hallado) for r in Q.golden_diff(base, other, ["codigo"], ["n", "unidad"]).collect()}
    assert found == {("77", "sobra", "unidad", None, "u"), ("123", "difiere", "n", None, "23"), ("x", "falta", "n", "5", None), ("x", "falta", "unidad", "u", None)}
    left, right = Q.differing(base, other, ["codigo"], ["n", "unidad"])
    assert left.count() <= 4 and right.count() <= 4
    assert all(side.isEmpty() for side in Q.differing(base, base.repartition(3), ["codigo"], ["n", "unidad"]))
    swapped = spark.createDataFrame([("a", None, "1"), ("b", "1", None)], "codigo string, p string, q string")
    turned = spark.createDataFrame([("a", "1", None), ("b", None, "1")], "codigo string, p string, q string")
    assert Q.golden_diff(swapped, turned, ["codigo"], ["p", "q"]).count() == 4


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, v int")
    assert [tuple(r) for r in Q.duplicate_keys(rows, "k").collect()] == [("a", 2)]
