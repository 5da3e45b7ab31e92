"""Rankings, top-k, curves and bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from preciario.constants import (
    CAPITULO_DESTACADO,
    COMPONENTES,
    N_DESTACADOS,
    N_TRAMOS_MAPA,
    TRAMOS_NIVEL,
    URLS_POR_PARTE,
)
from preciario.functions.codes import chapter_number, natural_key
from preciario.functions.money import exact_units, from_units
from preciario.functions.ordering import positions, value_bucket
from preciario.functions.text import first_line


def rank_province(summary: DataFrame) -> DataFrame:
    """Place from the cheapest among the provinces with a median, and how many."""
    priced = summary.where(F.col("mediana") > 0).select("slug", "mediana")
    total = priced.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = positions(priced, [], ["mediana", "slug"], value_bucket(F.col("mediana")), name="puesto")
    return ranked.withColumn("total", total)


def topk_lines(lines: DataFrame, k: int = 3) -> DataFrame:
    """The k largest lines of each component.  The rank filter becomes a group
    limit before the shuffle, so each task sends at most k rows per group."""
    group = ["codigo", "slug", "componente"]
    order = [F.col("subtotal").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ranked = lines.where(F.col("subtotal") > 0).withColumn("puesto", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("puesto") <= k).select(*group, "puesto", "codigoInsumo", "descripcion", "subtotal")


def _top_and_totals(lines: DataFrame, k: int) -> DataFrame:
    """Top lines next to the count, sum and visible sum of their group.

    Both sides are partitioned by the group, so the join and the window over at
    most k rows add no exchange.
    """
    group = ["codigo", "slug", "componente"]
    totals = (
        lines.where(F.col("subtotal") > 0)
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(exact_units(F.col("subtotal"))).alias("suma"))
    )
    seen = F.sum(exact_units(F.col("subtotal"))).over(W.partitionBy(*group))
    return topk_lines(lines, k).join(totals, group).withColumn("visto", seen)


def topk_lines_with_other(lines: DataFrame, k: int = 3) -> DataFrame:
    """Top k lines per component and, where lines remain, one row for the rest.

    The rest is the group total minus the visible part, both whole units, so
    no group is ever ranked beyond its k-th row.
    """
    line = F.struct(
        "puesto", "codigoInsumo", F.lit(1).cast("long").alias("n"), F.col("subtotal").cast("double").alias("valor")
    )
    other = F.struct(
        F.lit(k + 1).alias("puesto"),
        F.lit(None).cast("string").alias("codigoInsumo"),
        (F.col("n") - k).alias("n"),
        from_units(F.col("suma") - F.col("visto")).alias("valor"),
    )
    rest = F.when((F.col("puesto") == 1) & (F.col("n") > k), other)
    rows = _top_and_totals(lines, k).select(
        "codigo", "slug", "componente", F.explode(F.array_compact(F.array(line, rest))).alias("x")
    )
    return rows.select("codigo", "slug", "componente", "x.*")


def flow_edges(lines: DataFrame, k: int = 3) -> DataFrame:
    """Edges root -> component -> line or rest."""

    def edge(origen: Column, destino: Column, puesto: Column, valor: Column) -> Column:
        return F.struct(
            origen.alias("origen"), destino.alias("destino"), puesto.alias("puesto"), valor.cast("double").alias("valor")
        )

    first, componente = F.col("puesto") == 1, F.col("componente")
    rest = F.concat(F.lit("Otras líneas ("), (F.col("n") - k).cast("string"), F.lit(")"))
    edges = F.array(
        F.when(first, edge(F.lit("Costo directo"), componente, F.lit(0), from_units(F.col("suma")))),
        edge(componente, F.col("codigoInsumo"), F.col("puesto"), F.col("subtotal")),
        F.when(first & (F.col("n") > k), edge(componente, rest, F.lit(k + 1), from_units(F.col("suma") - F.col("visto")))),
    )
    return _top_and_totals(lines, k).select("codigo", "slug", F.explode(F.array_compact(edges)).alias("e")).select(
        "codigo", "slug", "e.*"
    )


def featured_family(catalog: DataFrame, chapter: str = CAPITULO_DESTACADO) -> DataFrame:
    return catalog.where((F.col("capitulo") == chapter) & (F.col("mediana") > 0))


def featured_round_robin(catalog: DataFrame, limit: int = N_DESTACADOS, chapter: str = CAPITULO_DESTACADO) -> DataFrame:
    """Featured items: the reference family first, then one item per chapter and
    turn by falling median.  A family item uses up its turn in its chapter.

    Only the first ``limit`` turns of a chapter and the first ``limit`` family
    items can be listed, so both ranks are limited before anything is shuffled.
    """
    key = natural_key(F.col("codigo"))
    rows = catalog.where(F.col("mediana") > 0).select(
        "codigo", "capitulo", "mediana", chapter_number(F.col("capituloNumero"), F.col("capitulo")).alias("numero")
    )
    family = F.col("capitulo") == chapter
    turns = rows.withColumn("turno", F.row_number().over(W.partitionBy("numero").orderBy(F.col("mediana").desc(), key)))
    others = turns.where(F.col("turno") <= limit).where(~family)
    first = rows.where(family).withColumn("_k", key).orderBy("_k").limit(limit).withColumn("turno", F.lit(0)).drop("_k")
    # Family sorts by code alone, the rest by turn and chapter.
    listed = first.withColumn("grupo", F.lit(0)).unionByName(others.withColumn("grupo", F.lit(1)))
    order = [F.col("grupo"), F.col("turno"), F.when(F.col("grupo") == 1, F.col("numero")), key]
    short = listed.orderBy(*order).limit(limit)
    return short.withColumn("posicion", F.row_number().over(W.orderBy(*order))).select("posicion", "codigo", "mediana")


def price_curve(facts: DataFrame) -> DataFrame:
    """Priced regions of each item from cheap to dear, ends flagged.

    A group has one row per region.
    """
    order = W.partitionBy("codigo").orderBy("costoDirecto", "slug")
    priced = facts.where(F.col("costoDirecto") > 0)
    curve = priced.select(
        "codigo", "slug", F.col("costoDirecto").alias("valor"), F.row_number().over(order).alias("puesto"),
        F.count(F.lit(1)).over(W.partitionBy("codigo")).alias("total"),
        F.median("costoDirecto").over(W.partitionBy("codigo")).alias("mediana"),
    )
    return curve.withColumns({"primera": F.col("puesto") == 1, "ultima": F.col("puesto") == F.col("total")})


def median_region_pick(facts: DataFrame) -> DataFrame:
    """The region in the middle of each item's ascending costs (a real row)."""
    return price_curve(facts).where(F.col("puesto") == F.floor(F.col("total") / 2) + 1).select("codigo", "slug", "valor")


def share_of_total(facts: DataFrame) -> DataFrame:
    """Component shares of the direct cost; null when the cost is 0."""
    cost = F.col("costoDirecto")
    return facts.withColumns({f"peso_{c}": F.when(cost != 0, F.col(c) / cost) for c in COMPONENTES})


def components_long(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The four component totals as rows, positive ones only."""
    return facts.unpivot(keys, list(COMPONENTES), "componente", "valor").where(F.col("valor") > 0)


def bin_equal_width(rows: DataFrame, value: str, bins: int = N_TRAMOS_MAPA, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bin over [min, max] per group; one single value falls in the
    last bin.  The range is an aggregate joined back, not a window, so a group
    may be of any size."""
    keys = keys or []
    span = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if keys:
        joined = rows.join(span, keys)
    else:
        both = span.select(F.struct("_lo", "_hi").alias("s")).scalar()
        joined = rows.withColumn("_s", both).select(*rows.columns, "_s._lo", "_s._hi")
    place = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    tramo = F.when(F.col("_hi") <= F.col("_lo"), F.lit(bins - 1)).otherwise(F.least(F.lit(bins - 1), F.floor(place * bins)))
    return joined.withColumn("tramo", tramo.cast("int")).drop("_lo", "_hi")


def bin_thresholds(rows: DataFrame, value: str, bounds: tuple[float, ...] = TRAMOS_NIVEL) -> DataFrame:
    """First right-closed bound that holds the value; values <= 0 get no bin."""
    v = F.col(value)
    chain = reduce(lambda c, b: c.when(v <= b[1], b[0]), list(enumerate(bounds))[1:], F.when(v <= bounds[0], 0))
    return rows.withColumn("tramo", F.when(v > 0, chain.otherwise(len(bounds))))


def contiguous_groups(rows: DataFrame, within: list[str], order: list[Column | str], key: str) -> DataFrame:
    """Number the runs of equal ``key`` in a sorted list, per ``within`` group."""
    w = W.partitionBy(*within).orderBy(*order)
    change = ~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("_c", change.cast("int")).withColumn(
        "grupo", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    ).drop("_c")


def global_ordinal(pairs: DataFrame) -> DataFrame:
    """0-based place of every (codigo, slug) pair in code order, then slug.

    Counts are added level by level (three-digit chapter, item, pair): only the
    chapter level is ordered as a whole, and no window spans more than a chapter's
    items or an item's regions.
    """
    coded = pairs.withColumn("_c", F.split_part("codigo", F.lit("."), F.lit(1)).cast("long"))
    items = coded.groupBy("_c", "codigo").agg(F.count(F.lit(1)).alias("n"))
    chapters = (
        items.groupBy("_c")
        .agg(F.sum("n").alias("n"))
        .select("_c", F.coalesce(F.sum("n").over(W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o1"))
    )
    in_chapter = W.partitionBy("_c").orderBy(natural_key(F.col("codigo"))).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        items.withColumn("_o2", F.coalesce(F.sum("n").over(in_chapter), F.lit(0)))
        .join(chapters, "_c")
        .select("codigo", (F.col("_o1") + F.col("_o2")).alias("_o"))
    )
    rank = F.row_number().over(W.partitionBy("codigo").orderBy("slug")) - 1
    return pairs.withColumn("_r", rank).join(starts, "codigo").withColumn("ordinal", F.col("_o") + F.col("_r")).drop("_o", "_r")


def chunk_ordinal(pairs: DataFrame, size: int = URLS_POR_PARTE) -> DataFrame:
    """Fixed order cut into parts of ``size`` rows."""
    return global_ordinal(pairs).withColumn("parte", F.expr(f"ordinal div {size}"))


def top_dispersed(catalog: DataFrame, n: int = 10, min_regions: int = 10) -> DataFrame:
    """Items whose maximum is furthest from their median, as a ratio."""
    rows = catalog.where((F.col("mediana") > 0) & (F.col("conDato") >= min_regions))
    return (
        rows.select(
            "codigo", first_line(F.col("descripcion")).alias("titulo"), "unidad",
            (F.col("max") / F.col("mediana")).alias("razon"), "min", "max", "mediana",
        )
        .orderBy(F.col("razon").desc(), natural_key(F.col("codigo")))
        .limit(n)
    )
