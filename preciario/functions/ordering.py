"""Dense positions and exact medians whose groups may be arbitrarily large.

A plain ``row_number`` or ``median`` brings a whole group into one task.  Both
functions here cut each group by a monotone tile of its order key, count the
tiles with map-side combining, and only ever sort inside one tile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def _right(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rename join keys so both sides of a self-join stay distinguishable."""
    return df.withColumnsRenamed({k: f"_r_{k}" for k in keys})


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))


def _solid(df: DataFrame, key: str) -> Column:
    """A key without nulls, by a value of its type; types other than text and numbers as text."""
    kind = df.schema[key].dataType
    if isinstance(kind, NumericType):
        return F.coalesce(F.col(key), F.lit(0).cast(kind))
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def positions(
    df: DataFrame,
    keys: list[str],
    order_by: list[str | Column],
    tile: Column,
    name: str = "orden",
) -> DataFrame:
    """Add the 1-based position of each row inside its group.

    ``tile`` must not decrease along ``order_by``.  Groups that fit in one tile,
    the common case, need no offset, so the joined side holds only large groups.

    Rows are exchanged and sorted once: keys stand without nulls beside a mask of which are null, so the join with the
    offsets is by plain equality and takes the rows as the window has put them.
    """
    at = [f"_k{i}" for i in range(len(keys))] + ["_null"]
    null = reduce(lambda a, b: a + b, (F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    kept = [k for k in keys if not isinstance(df.schema[k].dataType, (NumericType, StringType))]
    rest = [c for c in df.columns if c not in keys or c in kept]
    tiled = df.withColumns({**{f"_k{i}": _solid(df, k) for i, k in enumerate(keys)}, "_null": null, "_tile": tile}).withColumn(
        "_none", F.col("_tile").isNull()
    )
    solid = _solid(tiled, "_tile")
    inner = W.partitionBy(*at, "_none", "_tile").orderBy(*order_by)
    before = W.partitionBy(*at).orderBy(F.desc("_none"), "_tile").rowsBetween(W.unboundedPreceding, -1)
    tiled = tiled.withColumn("_tile", solid)
    offsets = (
        tiled.groupBy(*at, "_none", "_tile")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(before))
        .where(F.col("_before") > 0)
        .select(*at, "_none", "_tile", "_before")
    )
    ranked = tiled.withColumn("_rank", F.row_number().over(inner))
    on = [*at, "_none", "_tile"]
    joined = ranked.join(_right(offsets, on), reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_r_{k}") for k in on)), "left")
    position = (F.col("_rank") + F.coalesce(F.col("_before"), F.lit(0))).cast("long")
    whole = {k: F.when(F.col("_null").bitwiseAND(1 << i) == 0, F.col(f"_k{i}")).alias(k) for i, k in enumerate(keys) if k not in kept}
    return joined.select(*(whole.get(c, F.col(c)) for c in df.columns), position.alias(name))


#: Buckets of an octave, how often the middle bucket is cut again, into how many, and over how many tasks its values are dealt.
PER_OCTAVE, REFINEMENTS, CUTS, SALTS = 128, 2, 1024, 16


def value_bucket(value: Column, per_octave: int = PER_OCTAVE) -> Column:
    """Monotone bucket of a number: a fixed count of buckets per power of two, and finer ones inside coarser ones."""
    return (
        F.when(value > 0, F.floor(F.log2(value) * per_octave))
        .when(value == 0, F.lit(-1100 * per_octave))
        .otherwise(-2200 * per_octave - F.floor(F.log2(-value) * per_octave))
        .cast("long")
    )


def group_median(
    df: DataFrame,
    keys: list[str],
    value: str,
    name: str = "mediana",
    count: str = "n",
    per_octave: int = PER_OCTAVE,
    refinements: int = REFINEMENTS,
) -> DataFrame:
    """Exact interpolated median and row count per group, nulls left out.

    Distinct values are counted first (map-side combine), and a histogram per group finds the one or two buckets that
    hold the middle.  These are cut ``CUTS``-fold again, ``refinements`` times, so that wherever values crowd the last
    buckets, the only ones that are sorted, hold few distinct ones (an octave has 2 ** 27 of them).  A histogram has at most
    ``4200 * per_octave`` rows a group, one of a refinement ``2 * CUTS``; the values of a bucket are read by ``SALTS`` tasks.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    salt = F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int")
    widths = [per_octave * CUTS**i for i in range(refinements + 1)]

    def inside_middle(middle: DataFrame, width: int) -> DataFrame:
        """The counted values of the middle buckets."""
        dealt = middle.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        at = [*keys, "_b", "_s"]
        rows = counted.withColumns({"_b": value_bucket(F.col("_v"), width), "_s": salt})
        return rows.join(_right(dealt, at), _same(at)).select(*keys, "_b", "_v", "_c", "_start", "_n", "_lo", "_hi")

    running = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    histogram = (
        counted.groupBy(*keys, value_bucket(F.col("_v"), widths[0]).alias("_b"))
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_upto", F.sum("_bc").over(running))
        .withColumn("_n", F.sum("_bc").over(W.partitionBy(*keys)))
        .withColumn("_lo", F.expr("(_n - 1) div 2"))
        .withColumn("_hi", F.expr("_n div 2"))
    )
    start = F.col("_upto") - F.col("_bc")
    holding = (start <= F.col("_hi")) & (F.col("_upto") > F.col("_lo"))
    middle = histogram.where(holding).select(*keys, "_b", start.alias("_start"), "_n", "_lo", "_hi")
    for before, width in zip(widths, widths[1:]):
        cut = W.partitionBy(*keys, "_a").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
        finer = (
            inside_middle(middle, before)
            .groupBy(*keys, F.col("_b").alias("_a"), value_bucket(F.col("_v"), width).alias("_b"), "_start", "_n", "_lo", "_hi")
            .agg(F.sum("_c").alias("_bc"))
            .withColumn("_upto", F.col("_start") + F.sum("_bc").over(cut))
        )
        middle = finer.where(holding).select(*keys, "_b", start.alias("_start"), "_n", "_lo", "_hi")
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = inside_middle(middle, widths[-1]).withColumn("_end", F.col("_start") + F.sum("_c").over(inside))

    def holds(rank: str) -> Column:
        return (F.col("_end") > F.col(rank)) & (F.col("_end") - F.col("_c") <= F.col(rank))

    return placed.groupBy(*keys).agg(
        ((F.min(F.when(holds("_lo"), F.col("_v"))) + F.min(F.when(holds("_hi"), F.col("_v")))) / 2).alias(name),
        F.max("_n").alias(count),
    )
