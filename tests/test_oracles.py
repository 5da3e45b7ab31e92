"""Every registered query against its DuckDB statement on the smallest tables."""

from __future__ import annotations

import pytest

from preciario.plans.registry import ORACLES, QUERIES, load_all
from tests.comparing import connect, differences

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, ORACLES[name]) == []


#: Key and order of the sorted queries; a collation of the alphabet stands for DuckDB's.
SPANISH = "strip_accents(lower(departamento)), strip_accents(lower(provincia))"
NATURAL = "list_transform(string_split(codigo, '.'), lambda p: CAST(p AS BIGINT))"
ORDERS = {
    "sort_natural_code": (["codigo", "slug"], f"{NATURAL}, slug"),
    "sort_locale": (["departamento", "provincia"], SPANISH),
    "province_roster": (["departamento", "provincia"], SPANISH),
    "sort_lines": (["codigo", "slug", "orden"], "codigo, slug, subtotal DESC, orden"),
    "sort_supply": (["codigoInsumo", "slug"], "codigoInsumo, slug"),
    "list_item_keys": (["codigo"], NATURAL),
    "list_region_keys": (["slug"], "slug"),
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(spark, duck, name):
    key, order = ORDERS[name]
    wanted = duck.execute(f"SELECT {', '.join(key)} FROM ({ORACLES[name]}) ORDER BY {order}").fetchall()
    assert [tuple(r[k] for k in key) for r in QUERIES[name](spark, SF).collect()] == wanted


def test_missing_last_comes_in_order(spark):
    from preciario.operators.sorting import sort_missing_last

    rows = [("a", 1.0, 5.0), ("b", 0.0, 9.0), ("c", 2.0, 7.0), ("d", 0.0, 1.0), ("e", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "codigo string, costoDirecto double, equipo double").repartition(3)
    assert [r.codigo for r in sort_missing_last(df, "equipo", True, "codigo").collect()] == ["c", "a", "e", "b", "d"]
    assert [r.codigo for r in sort_missing_last(df, "equipo", False, "codigo").collect()] == ["a", "e", "c", "b", "d"]


@pytest.mark.parametrize(("by", "descending", "wanted"), [("orden", False, "abcd"), ("cantidad", True, "bdca"), ("precioUnitario", False, "dcab"), ("descripcion", False, "cdba")])
def test_line_table_orders(spark, by, descending, wanted):
    """By place, quantity, price and name, which follows the Spanish alphabet."""
    from preciario.operators.sorting import sort_lines

    rows = [("1", "s", 1, 1.0, 30.0, "Ñame", "a"), ("1", "s", 2, 9.0, 40.0, "nube", "b"), ("1", "s", 3, 2.0, 20.0, "Árbol", "c"), ("1", "s", 4, 3.0, 10.0, "arena", "d")]
    df = spark.createDataFrame(rows, "codigo string, slug string, orden int, cantidad double, precioUnitario double, descripcion string, n string").repartition(3)
    assert "".join(r.n for r in sort_lines(df, by, descending).collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_manifest_hashes(spark):
    import hashlib
    import pathlib

    from preciario.sources import storage as S

    found = {r.filename: (r.bytes, r.sha256, r.codigo) for r in S.file_manifest(S.hashed_files(spark, SF, "*.parquet")).collect()}
    expected = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest(), "") for p in pathlib.Path(SF).glob("*.parquet")}
    assert found == expected
