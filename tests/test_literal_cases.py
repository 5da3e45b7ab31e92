"""Small published cases, one per rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from preciario.functions import codes, money, text
from preciario.operators import aggregates as A
from preciario.operators import clean, filters as P, joins as J, markup as M, ranking as R, sorting as S


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, expected", [(5792090.8600000003, 5792090.86), (-0.0, 0.0), (1.005, 1.0), (0.285, 0.28), (2.5, 2.5), (0.125, 0.13)]
)
def test_round_money(spark, raw, expected):
    found = one(spark, money.round_money(F.lit(raw)))
    assert found == expected and str(found) != "-0.0"


def test_natural_order(spark):
    codes_in = ["200.12", "200.2", "730.4.1", "730.4", "200.1.1"]
    rows = S.sort_natural_code(values(spark, [(c,) for c in codes_in], "codigo string")).collect()
    assert [r.codigo for r in rows] == ["200.1.1", "200.2", "200.12", "730.4", "730.4.1"]


@pytest.mark.parametrize(
    "label, expected",
    [
        ("Capitulo 2\nExplanaciones", (2, "Explanaciones")),
        ("CAPÍTULO 6\r\n Estructuras  y\ndrenajes", (6, "Estructuras y drenajes")),
        ("Capitulo 2", None),
        ("Otra cosa", None),
        (None, None),
    ],
)
def test_chapter_label(spark, label, expected):
    found = one(spark, codes.chapter_label(F.lit(label).cast("string")))
    assert (found and (found.numero, found.nombre)) == expected


def _stats(spark, costs):
    df = values(spark, [("a", float(c)) for c in costs], "codigo string, costoDirecto double")
    built_in = df.groupBy("codigo").agg(*A.positive_stats()).first()
    spread = A.agg_positive(df, ["codigo"]).first()
    overall = A.agg_positive(df, []).first()
    found = {(r.min, r.max, r.mediana, r.promedio, r.conDato) for r in (built_in, spread, overall)}
    assert len(found) == 1
    return found.pop()


def test_positive_stats(spark):
    assert _stats(spark, [0, 0, 0]) == (0, 0, 0, 0, 0)
    assert _stats(spark, [1, 1, 2]) == (1, 2, 1, 1.33, 3)
    assert _stats(spark, [1, 2, 3, 4, 0]) == (1, 4, 2.5, 2.5, 4)
    assert _stats(spark, [7.5]) == (7.5, 7.5, 7.5, 7.5, 1)


def test_positive_stats_of_nothing(spark):
    empty = values(spark, [], "codigo string, costoDirecto double")
    assert A.agg_positive(empty, []).collect() == [(0.0, 0.0, 0.0, 0.0, 0)]
    assert A.agg_positive(empty, ["codigo"]).collect() == []


FACT = "codigo string, slug string, regionCodigoDane string, departamento string, capitulo string, capituloNumero int, capituloNombre string, equipo double, materiales double, transporte double, manoDeObra double, costoDirecto double"


def fact(codigo, slug, costo, shares=(1, 0, 0, 0), dane="05", dept="Antioquia", numero=None, nombre=None):
    parts = [costo * s for s in shares]
    return (codigo, slug, dane, dept, codigo.split(".")[0], numero, nombre, *map(float, parts), float(costo))


def test_composition_averages_shares(spark):
    facts = values(
        spark,
        [
            fact("630.1", "a", 100, (0.5, 0.5, 0, 0), numero=6, nombre="Estructuras"),
            fact("630.1", "b", 1_000_000, (0.5, 0.5, 0, 0), numero=6, nombre="Estructuras"),
            fact("200.1", "a", 0),
        ],
        FACT,
    )
    (row,) = A.composition_by_chapter(facts).collect()
    assert (row.numero, row.nombre, row.apus) == (6, "Estructuras", 2)
    assert row.equipo == pytest.approx(0.5) and row.materiales == pytest.approx(0.5) and row.transporte == 0
    assert A.apus_with_data(A.composition_by_chapter(facts)).first().apusConDato == 2


CATALOG = "codigo string, capitulo string, capituloNumero int, capituloNombre string, mediana double"


def catalog(spark, *rows):
    return values(spark, [(c, c.split(".")[0], n, t, float(m)) for c, m, n, t in rows], CATALOG)


def test_relative_level(spark):
    facts = values(
        spark,
        [fact("630.1", "x", 150, dane="91", dept="Amazonas"), fact("640.1", "x", 260, dane="91", dept="Amazonas")]
        + [fact("630.1", s, c) for s, c in (("a", 90), ("b", 110), ("c", 0))]
        + [fact("999.1", "z", 5, dane="99", dept="Vichada")],
        FACT,
    )
    cat = catalog(spark, ("630.1", 100, None, None), ("640.1", 200, None, None))
    rows = {(r.codigoDane, r.numero): (r.razon, r.apus) for r in A.relative_level(facts, cat, J.chapter_map(cat)).collect()}
    assert rows[("91", 6)] == (pytest.approx(1.4), 2)
    assert rows[("05", 6)] == (pytest.approx(1.0), 2)
    assert rows[("99", None)] == (None, 0)


def test_compare_chapters(spark):
    est, exp = "Estructuras y drenajes", "Explanaciones"
    cat = catalog(
        spark,
        ("630.1.1", 100, 6, est), ("630.1.2", 200, 6, est), ("630.1.3", 900, 6, est),
        ("201.1", 50, 2, exp), ("201.2", 70, 2, exp), ("700.1", 400, None, None),
    )
    costs = {"630.1.1": 150, "630.1.2": 250, "630.1.3": 0, "800.1": 300, "201.1": 0, "201.2": 0, "700.1": 500}
    facts = values(spark, [fact(c, "p", v) for c, v in costs.items()], FACT)
    rows = {
        r.numero: (r.nombre, r.medianaProvincia, r.medianaNacional, r.conDato, r.total)
        for r in A.compare_chapters(facts, cat, J.chapter_map(cat)).collect()
    }
    assert rows == {
        6: (est, 200, 150, 2, 3),
        2: (exp, 0, 60, 0, 2),
        7: ("Capítulo 7", 500, 400, 1, 1),
        8: ("Capítulo 8", 300, 0, 1, 1),
    }


LINE = "codigo string, slug string, componente string, codigoInsumo string, descripcion string, subtotal double, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"


def test_topk_with_other(spark):
    amounts = [("d", 10), ("a", 40), ("b", 30), ("c", 15), ("e", 5), ("z", 0)]
    rows = [("630.1", "p", "equipo", n, n, float(v), i, 1, 1, 1) for i, (n, v) in enumerate(amounts)]
    rows.append(("630.1", "p", "materiales", "m", "m", 50.0, 9, 1, 1, 1))
    rows.append(("630.1", "p", "transporte", "t", "t", 0.0, 9, 1, 1, 1))
    lines = values(spark, rows, LINE)
    found = {(r.componente, r.puesto): (r.codigoInsumo, r.n, r.valor) for r in R.topk_lines_with_other(lines).collect()}
    assert found == {
        ("equipo", 1): ("a", 1, 40), ("equipo", 2): ("b", 1, 30), ("equipo", 3): ("c", 1, 15), ("equipo", 4): (None, 2, 15),
        ("materiales", 1): ("m", 1, 50),
    }
    edges = {(r.origen, r.destino): r.valor for r in R.flow_edges(lines).collect()}
    assert edges[("Costo directo", "equipo")] == 100 and edges[("equipo", "Otras líneas (2)")] == 15


def test_top_dispersed(spark):
    schema = "codigo string, descripcion string, unidad string, conDato long, min double, max double, mediana double"
    rows = [("1.1", 100, 300, 140), ("1.2", 100, 1000, 140), ("1.3", 100, 150, 140), ("1.4", 0, 10, 140), ("1.5", 100, 900, 3)]
    cat = values(spark, [(c, f"Ítem {c}\n(alcance)", "m3", n, m / 2, float(x), float(m)) for c, m, x, n in rows], schema)
    top = R.top_dispersed(cat, n=2).collect()
    assert [(r.codigo, r.razon, r.titulo) for r in top] == [("1.2", 10.0, "Ítem 1.2"), ("1.1", 3.0, "Ítem 1.1")]


def test_rank_province(spark):
    rows = [("cara", 300.0), ("barata", 100.0), ("media", 200.0), ("sin-dato", 0.0)]
    found = {r.slug: (r.puesto, r.total) for r in R.rank_province(values(spark, rows, "slug string, mediana double")).collect()}
    assert found == {"barata": (1, 3), "media": (2, 3), "cara": (3, 3)}


def test_dept_median_keeps_zeros(spark):
    rows = values(spark, [("05", 0.0), ("05", 10.0), ("08", 4.0)], "regionCodigoDane string, mediana double")
    found = {r.regionCodigoDane: r.medianaDepartamento for r in A.dept_median_of_medians(rows).collect()}
    assert found == {"05": 5.0, "08": 4.0}
    assert A.national_median_of_provinces(rows).first().medianaNacional == 7.0


def test_featured_round_robin(spark):
    cat = catalog(
        spark,
        ("630.2", 50, 6, None), ("630.1", 10, 6, None), ("640.1", 90, 6, None), ("640.2", 20, 6, None),
        ("201.1", 5, 2, None), ("201.2", 7, 2, None), ("201.3", 0, 2, None), ("700.1", 1, None, None),
    )
    rows = R.featured_round_robin(cat, limit=6).orderBy("posicion").collect()
    # Turn 1: 201.2, 640.1, 700.1; turn 2: 201.1 and, for chapter 6, 630.2, which is spent.
    assert [r.codigo for r in rows] == ["630.1", "630.2", "201.2", "640.1", "700.1", "201.1"]
    assert [r.codigo for r in R.featured_family(cat).collect()] == ["630.2", "630.1"]


def test_equal_width_bins(spark):
    rows = values(spark, [("a", 0.0), ("a", 10.0), ("a", 60.0), ("a", 59.9), ("b", 5.0)], "k string, v double")
    found = sorted((r.k, r.v, r.tramo) for r in R.bin_equal_width(rows, "v", keys=["k"]).collect())
    assert found == [("a", 0.0, 0), ("a", 10.0, 1), ("a", 59.9, 5), ("a", 60.0, 5), ("b", 5.0, 5)]
    assert {r.tramo for r in R.bin_equal_width(rows.where("k = 'b'"), "v").collect()} == {5}


def test_threshold_bins(spark):
    rows = values(spark, [(v,) for v in (0.0, 0.9, 0.91, 1.0, 1.1, 1.5, 9.0)], "v double")
    assert [r.tramo for r in R.bin_thresholds(rows, "v").collect()] == [None, 0, 1, 2, 3, 4, 5]


def test_markup(spark):
    rows = values(spark, [(100.0,), (0.0,)], "costoDirecto double")
    out = M.markup_columns(M.with_scenarios(rows, M.scenarios(("x", 15, 3, 5, "utilidad")))).collect()
    full, zero = out
    assert (full.administracion, full.imprevistos, full.utilidad) == (15, 3, 5)
    assert full.iva == pytest.approx(0.95) and full.total == pytest.approx(123.95) and full.fraccionAiu == pytest.approx(0.23)
    assert zero.total == 0 and zero.fraccionAiu == 0
    sweep = M.markup_sweep(rows.limit(1), hasta=4, paso=2).orderBy("porcentaje").collect()
    assert [(r.porcentaje, r.total) for r in sweep] == [(0, 100.0), (2, 102.0), (4, 104.0)]


@pytest.mark.parametrize(
    "raw, expected",
    [("12x", 12), ("perro", 0), ("-3", 0), ("250", 100), (None, 0), ("Infinity", 0), (" 7.5 ", 7.5), (".5", 0.5), ("1e1", 10), ("", 0), ("100", 100)],
)
def test_clamp_percent(spark, raw, expected):
    assert one(spark, money.clamp_percent(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    "query, hit",
    [("", True), ("   ", True), ("excavacion", True), ("EXCAVACIÓN", True), ("muniz", True), ("630.1", True), ("apus", True), ("zzz", False)],
)
def test_search(spark, query, hit):
    rows = values(spark, [("630.1", "Excavación Muñiz APU´S")], "codigo string, titulo string")
    assert (P.search_item(rows, query).count() == 1) is hit


def test_search_any_ignores_missing_texts(spark):
    rows = values(spark, [(None, "Antioquía"), ("x", None)], "a string, b string")
    assert P.search_any(rows, ["a", "b"], "antioquia").count() == 1
    assert P.search_any(rows, ["a", "b"], "").count() == 2


def test_clean_text(spark):
    cases = {
        "  a \t  b  \r\n   c\rd  ": "a b\nc\nd",
        "café": "café",
        "  \n ": None,
        "﻿x　": "x",
        "Å": "Å",
        None: None,
    }
    rows = values(spark, list(enumerate(cases)), "i int, t string")
    found = [r.t for r in clean.clean_cells(rows, "t").orderBy("i").collect()]
    assert found == list(cases.values())


def test_split_description(spark):
    rows = values(spark, [("CONCRETO  \n(Suministro\ny curado)",), ("SOLO",), ("A\n()",), ("A\n",)], "descripcion string")
    found = [tuple(r)[1:] for r in clean.split_descriptions(rows).collect()]
    assert found[0] == ("CONCRETO", "CONCRETO  ", "(Suministro\ny curado)", "Suministro\ny curado", "(Suministro y curado)")
    assert found[1] == ("SOLO", "SOLO", None, "", None)
    assert found[2] == ("A", "A", "()", "", "()")
    assert found[3] == ("A", "A", None, "", None)


@pytest.mark.parametrize(
    "raw, expected",
    [("VALLE DE ABURRÁ", "Valle de Aburrá"), ("NORTE_DE_SANTANDER", "Norte de Santander"), ("LA GUAJIRA", "La Guajira"), ("ÑANDÚ Y EL RÍO", "Ñandú y el Río")],
)
def test_title_case(spark, raw, expected):
    assert one(spark, text.title_case(F.lit(raw))) == expected


def test_slug(spark):
    assert one(spark, text.slugify(F.lit("Antioquia"), F.lit("Valle de Aburrá"))) == "antioquia-valle-de-aburra"
    assert one(spark, text.slugify(F.lit("Bogotá D.C."), F.lit("¡Ñandú!"))) == "bogota-d-c-nandu"


def test_text_equivalent(spark):
    assert one(spark, text.equivalent(F.lit(" iv.  mano DE obra"), F.lit("IV. MANO DE OBRA ")))
    assert one(spark, text.equivalent(F.lit("ÍNDICE"), F.lit("indice")))
    assert not one(spark, text.equivalent(F.lit("a b"), F.lit("ab")))


def test_units(spark):
    raw = ["m3 - E", "M3 - KM", "m 3-km", "Kg", "KG", "día", "Global", " m³ ", "", None, "L", "l"]
    rows = values(spark, list(enumerate(raw)), "i int, u string")
    found = [(r.unidad, r.unidadCruda, r.conocida) for r in clean.canonical_units(rows, "u").orderBy("i").collect()]
    assert found == [
        ("m3-km", "m3 - E", True), ("m3-km", "M3 - KM", True), ("m3-km", "m 3-km", True), ("kg", "Kg", True), ("kg", "KG", True),
        ("día", None, True), ("Global", None, False), ("m3", "m³", True), (None, None, None), (None, None, None), ("L", None, True), ("l", None, False),
    ]


def test_codes(spark):
    rows = values(spark, [("730,4",), ("730.4",), ("  ",), (None,)], "c string")
    assert [(r.hoja, r.codigo) for r in clean.normalize_codes(rows, "c").collect()] == [("730,4", "730.4")] * 2 + [(None, None)] * 2


def test_spanish_order(spark):
    rows = values(spark, [(n, n) for n in ("Oca", "Ñandú", "Nariño", "Ávila", "Zeta", "Nz")], "departamento string, provincia string")
    assert [r.departamento for r in S.sort_locale(rows, "departamento", "provincia").collect()] == ["Ávila", "Nariño", "Nz", "Ñandú", "Oca", "Zeta"]


@pytest.mark.parametrize("descending, expected", [(True, ["b", "a", "n"]), (False, ["a", "b", "n"])])
def test_missing_last(spark, descending, expected):
    rows = values(spark, [("a", 1.0, 1.0), ("n", 99.0, 0.0), ("b", 2.0, 2.0)], "slug string, equipo double, costoDirecto double")
    assert [r.slug for r in S.sort_missing_last(rows, "equipo", descending, "slug").collect()] == expected


def test_head_row_keeps_nulls(spark):
    rows = values(spark, [("x", "b", "later"), ("x", "a", None)], "codigo string, slug string, nota string")
    assert A.head_row(rows, ["codigo"], F.col("slug"), ("nota",)).first().nota is None


def test_contiguous_groups(spark):
    rows = values(spark, [(i, k) for i, k in enumerate("aabba")], "i int, k string")
    out = R.contiguous_groups(rows.withColumn("g", F.lit(1)), ["g"], ["i"], "k").orderBy("i").collect()
    assert [r.grupo for r in out] == [1, 1, 2, 2, 3]


def test_breakdown_adds_rounded_subtotals(spark):
    rows = [("630.1", "p", "equipo", "a", "a", 0.004, 1, 1, 1, 1), ("630.1", "p", "materiales", "b", "b", 0.004, 1, 1, 1, 1), ("630.1", "p", "materiales", "c", "c", 0.006, 1, 1, 1, 1)]
    found = {r.componente: (r.subtotal, r.lineas, r.total, r.lineasTotal) for r in A.breakdown(values(spark, rows, LINE)).collect()}
    assert found == {"equipo": (0.0, 1, 0.01, 3), "materiales": (0.01, 2, 0.01, 3)}


def test_published_aggregates(spark):
    """Twenty regions with a price and 120 without, as in a published item."""
    costs = [13.51] * 6 + [13.65] * 8 + [14.49] * 5 + [13.86]
    rows = [("650.5", f"r{i}", c) for i, c in enumerate(costs + [0.0] * 120)]
    row = values(spark, rows, "codigo string, slug string, costoDirecto double").groupBy("codigo").agg(*A.positive_stats()).first()
    assert (row.min, row.max, row.mediana, row.conDato) == (13.51, 14.49, 13.65, 20)


def test_trimming_long_texts_without_patterns(spark):
    """Ends are trimmed of every blank by their characters, not by a pattern that is tried at each blank of the text."""
    blanks = "\t\x0b\f         　﻿\r\n"
    rows = [(i, t) for i, t in enumerate(["a b", blanks + "á  b" + blanks, blanks, "", None, "x​", " a", "a ", "a  b", "Ñ\tb\n\n c"])]
    df = spark.createDataFrame(rows, "i int, t string").select("i", text.trim_all(F.col("t")).alias("f"), text.clean_text(F.col("t")).alias("c"), text.fold(F.col("t")).alias("l"))
    found = {r.i: (r.f, r.c) for r in df.collect()}
    assert found == {
        0: ("a b", "a b"), 1: ("á  b", "á b"), 2: ("", None), 3: ("", None), 4: (None, None), 5: ("x​", "x​"), 6: ("a", "a"), 7: ("a", "a"), 8: ("a  b", "a b"),
        9: ("Ñ\tb\n\n c", "Ñ b\n\nc"),
    }
    assert "regexp" not in df.select("f")._jdf.queryExecution().optimizedPlan().toString()
    assert {r.i: r.l for r in df.where("i in (4, 6, 9)").collect()} == {4: None, 6: " a", 9: "n\tb\n\n c"}
