"""Medians and positions against brute force, with one group holding most rows."""

from __future__ import annotations

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from preciario.functions.ordering import CUTS, PER_OCTAVE, REFINEMENTS, group_median, positions, value_bucket
from preciario.operators import joins as J, ranking as R


def skewed(seed, n=4000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}"
        kind = rng.randrange(4)
        value = [rng.uniform(0, 1e9), round(rng.uniform(0, 3), 2), 0.0, -rng.uniform(0, 5)][kind]
        rows.append((key, i, value if rng.random() > 0.05 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("per_octave", [1, 128])
def test_group_median(spark, seed, per_octave):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, "k string, i long, v double")
    groups = defaultdict(list)
    for key, _, value in rows:
        if value is not None:
            groups[key].append(value)
    expected = {k: (statistics.median(v), len(v)) for k, v in groups.items()}
    found = {r.k: (r.mediana, r.n) for r in group_median(df, ["k"], "v", per_octave=per_octave).collect()}
    assert found == expected
    overall = group_median(df, [], "v", per_octave=per_octave).first()
    everything = [v for vs in groups.values() for v in vs]
    assert (overall.mediana, overall.n) == (statistics.median(everything), len(everything))


def test_group_median_keeps_null_keys_and_repeats(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 2.0), ("a", 9.0)]
    found = {r.k: r.mediana for r in group_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert found == {None: 2.0, "a": 2.0}


def test_crowded_median(spark):
    """Nine in ten values in one bucket of the first histogram: what is sorted at last are a few distinct ones."""
    rng = random.Random(8)
    values = [1.0 + rng.randrange(10**7) * 1e-9 / 10 for _ in range(18000)] + [rng.uniform(0.1, 9) for _ in range(2000)] + [1.0] * 500
    df = spark.createDataFrame([("a", v) for v in values] + [("b", -v) for v in values[:999]], "k string, v double").repartition(5)
    found = {r.k: (r.mediana, r.n) for r in group_median(df, ["k"], "v").collect()}
    assert found == {"a": (statistics.median(values), len(values)), "b": (-statistics.median(values[:999]), 999)}

    def largest(width):
        return df.where("k = 'a'").select("v").distinct().groupBy(value_bucket(F.col("v"), width).alias("b")).count().agg(F.max("count")).first()[0]

    assert largest(PER_OCTAVE) > 8000 and largest(PER_OCTAVE * CUTS**REFINEMENTS) < 600


@pytest.mark.parametrize("width", [1, 7, 1000, 10**9])
def test_positions(spark, width):
    rng = random.Random(width)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", rng.randrange(3000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, i long")
    found = {r.i: r.orden for r in positions(df, ["k"], ["o", "i"], F.expr(f"o div {width}")).collect()}
    groups = defaultdict(list)
    for key, order, i in rows:
        groups[key].append((order, i))
    expected = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), start=1)}
    assert found == expected


def test_product_is_whole(spark):
    items = spark.range(37).select(F.col("id").cast("string").alias("codigo"))
    regions = spark.range(23).select(F.concat(F.lit("r"), "id").alias("slug"))
    pairs = {(r.codigo, r.slug) for r in J.cross_item_region(items, regions).collect()}
    assert len(pairs) == 37 * 23 == J.cross_item_region(items, regions).count()


def test_missing_pairs(spark):
    rows = [(str(i), f"r{j}") for i in range(10) for j in range(5) if (i + j) % 3]
    found = {tuple(r) for r in J.missing_pairs(spark.createDataFrame(rows, "codigo string, slug string")).collect()}
    assert found == {(str(i), f"r{j}") for i in range(10) for j in range(5)} - set(rows)


def test_global_ordinal(spark):
    codes = ["200.12", "200.2", "1000.1", "730.4", "730.4.1", "200"]
    pairs = [(c, s) for c in codes for s in ("b", "a", "c")]
    random.Random(0).shuffle(pairs)
    found = {(r.codigo, r.slug): (r.ordinal, r.parte) for r in R.chunk_ordinal(spark.createDataFrame(pairs, "codigo string, slug string"), 4).collect()}
    ordered = sorted(pairs, key=lambda p: ([int(x) for x in p[0].split(".")], p[1]))
    assert found == {p: (i, i // 4) for i, p in enumerate(ordered)}


def test_topk_with_one_large_group(spark):
    rng = random.Random(5)
    rows = [("c", "s", "equipo", f"n{i}", "d", float(rng.randrange(0, 50)), i, 1, 1, 1) for i in range(5000)]
    schema = "codigo string, slug string, componente string, codigoInsumo string, descripcion string, subtotal double, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    found = {r.puesto: (r.codigoInsumo, r.n, r.valor) for r in R.topk_lines_with_other(spark.createDataFrame(rows, schema), 3).collect()}
    ranked = sorted((r for r in rows if r[5] > 0), key=lambda r: (-r[5], r[6]))
    assert [found[i][0] for i in (1, 2, 3)] == [r[3] for r in ranked[:3]]
    assert found[4][1:] == (len(ranked) - 3, sum(r[5] for r in ranked[3:]))


def test_positions_exchange_rows_once(spark):
    """The rows themselves are exchanged and sorted for the window only, not again for the join with the offsets; null keys are groups."""
    rows = [(k, i, i // 3) for k in ("a", None, "b") for i in range(10)] + [("b", None, None)]
    df = spark.createDataFrame(rows, "k string, i long, t long").repartition(3)
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "-1")
    try:
        found = positions(df, ["k"], ["i"], F.col("t"), "at")
        text = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.k, r.i): r["at"] for r in found.collect()}
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    assert text.count("Exchange hashpartitioning") == 4
    assert got == {**{(k, i): i + 1 for k in ("a", None) for i in range(10)}, **{("b", i): i + 2 for i in range(10)}, ("b", None): 1}
