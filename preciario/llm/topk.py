"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block; scores never
leave a task.  What leaves is a histogram for each query and block, cut below the
block's own kth score (the kth score of all candidates can't lie lower).  The
histograms add up over blocks, which locates each kth score in one bin; the next
round scores again with that bin's range, until a bin is one integer wide: then
the kth score is known exactly.  A last pass gives out the scores above it and,
among equals, the smallest ids that are still needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from preciario.llm.shared import written
from preciario.llm.vectors import blocks_of, finite, packed, unpacked, widened

K = 20
BINS = 1024
#: Rows of a candidate block and of a query block; a task holds one of each.
CANDIDATES = 8192
QUERIES = 1024
#: Queries scored at once.
SLICE = 128
#: Scores beyond this are taken as this, so that a range fits a long.
LIMIT = 2**62 - 1
#: Lower than any score: no candidate.
NONE = -(2**63)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered vectors as longs, exactly; beyond ``LIMIT`` that limit."""
    width = max(queries.shape[1], candidates.shape[1])
    a, b = widened(queries, width), widened(candidates, width)
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1)
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    exact = whole(a) @ whole(b).T if width else np.zeros((len(a), len(b)), dtype=object)
    return np.array([[max(-LIMIT, min(LIMIT, int(v))) for v in row] for row in exact], np.int64).reshape(len(a), len(b))


def grid(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int):
    """Every block of queries against every block of candidates, each pair of blocks a group."""
    numbers = lambda name, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    left = queries.withColumnRenamed("block", "q").select("*", numbers("c", n_candidates))
    right = candidates.withColumnRenamed("block", "c").select("*", numbers("q", n_queries))
    return left.groupBy("q", "c").cogroup(right.groupBy("q", "c"))


def slices(left: pa.Table, right: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the queries: the slice, their scores (``NONE`` for the query itself), and both sides' ids."""
    if left.num_rows and right.num_rows:
        ids, x = unpacked(left.slice(0, 1).to_pylist()[0])
        others, y = unpacked(right.slice(0, 1).to_pylist()[0])
        for at in range(0, len(ids), SLICE):
            part = slice(at, at + SLICE)
            found = scores(x[part], y)
            found[ids[part, None] == others[None, :]] = NONE
            yield part, found, ids[part], others


def longs(schema: pa.Schema, columns: list[list[np.ndarray]]) -> pa.Table:
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns], schema=schema)


COUNTS = pa.schema([(n, pa.int64()) for n in ("query_id", "low", "width", "bin", "n")])
FOUND = pa.schema([(n, pa.int64()) for n in ("query_id", "id", "score")])


def histograms(k: int):
    """Counts of every query's ``k`` highest scores in a block: (query_id, low, width, bin, n).  Bins have
    ``width``, the first begins at ``low``; bin ``BINS`` holds all scores above the query's range."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        bounds = bounds_of(left)
        for part, found, ids, _ in slices(left, right):
            low, width = bounds[0][part, None], bounds[1][part, None]
            step = np.maximum(1, -(-width // BINS))
            n = found.shape[1]
            top = np.partition(found, n - k, axis=1)[:, n - k :] if n > k else found
            bins = np.where(top >= low + width, BINS, (np.minimum(top, low + width) - low) // step)
            keyed = (np.arange(len(ids))[:, None] * (BINS + 1) + bins)[top >= low]
            keyed, n = np.unique(keyed, return_counts=True)
            row = keyed // (BINS + 1)
            for column, values in zip(out, (ids[row], low[row, 0], step[row, 0], keyed % (BINS + 1), n), strict=True):
                column.append(values)
        return longs(COUNTS, out)

    return run


def selected(k: int):
    """Scores above the kth, and of those equal to it the ``k`` smallest ids of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        bounds = bounds_of(left)
        for part, found, ids, others in slices(left, right):
            kth = bounds[0][part, None]
            equal = (found == kth) & (found != NONE)
            equal &= np.cumsum(equal, axis=1) <= k  # candidates are in order of their ids
            row, at = np.nonzero((found > kth) | equal)
            for column, values in zip(out, (ids[row], others[at], found[row, at]), strict=True):
                column.append(values)
        return longs(FOUND, out)

    return run


def bounds_of(left: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Lowest score and width of the range of each query of a block, in the order of its ids."""
    ranges = left.column("ranges")[0].as_py() if left.num_rows else []
    return np.array([x["low"] for x in ranges], np.int64), np.array([x["width"] for x in ranges], np.int64)


def with_ranges(queries: DataFrame, ranges: DataFrame, n_queries: int) -> DataFrame:
    """Query blocks and the ranges of their queries, an array no longer than the block."""
    grouped = ranges.groupBy(block(n_queries).alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("id"), "low", "width"))).alias("ranges"))
    return queries.join(grouped, "block")


def block(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")


def top_k(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = K, scale: int = 64, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), key and score (long) of each query's ``k`` highest integer inner products.

    Components x are taken as floor(scale * x).  Candidates are all rows but those with the query's own
    id; ties go to the smaller id; if there are fewer than ``k`` candidates, all are returned.  Vectors that
    are null or hold null or non-finite components, and rows without id, take no part; a shorter vector
    counts as filled up with zeros.  A row that is repeated under one id is found once per row as
    candidate; of repeated queries the smallest vector is asked.  Other columns are not read.
    """
    rows = vectors.where(finite(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    asked = written(rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")), "asked")
    n, longest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    nc, nq = blocks_of(n, CANDIDATES), blocks_of(asked.count(), QUERIES)
    spread = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(nc))  # rows that repeat an id spread too
    candidates = written(packed(rows, spread, "id", "v"), "candidates")
    queries = written(packed(asked, block(nq), "id", "v"), "queries")

    reach = F.least(F.ceil(norm * (longest or 0.0) * 1.000001).cast("double") + 1, F.lit(float(LIMIT))).cast("long")
    reach = F.least(reach, F.lit(LIMIT))
    ranges = written(asked.select("id", (-reach).alias("low"), (reach * 2 + 1).alias("width")), "ranges")
    while not ranges.where("width > 1").isEmpty():
        counted = grid(with_ranges(queries, ranges, nq), candidates, nq, nc).applyInArrow(histograms(k), "query_id long, low long, width long, bin long, n long")
        total = counted.groupBy("query_id", "low", "width", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin"))) - F.col("n")
        reached = total.withColumn("above", above).where((F.col("above") < k) & (F.col("above") + F.col("n") >= k))
        reached = reached.select(F.col("query_id").alias("id"), (F.col("low") + F.col("bin") * F.col("width")).alias("low"), "width")
        # a query with fewer candidates than k wants them all
        found = asked.select("id").join(reached, "id", "left")
        ranges = written(found.select("id", F.coalesce("low", F.lit(-LIMIT - 1)).alias("low"), F.coalesce("width", F.lit(1)).cast("long").alias("width")), "ranges")
    best = grid(with_ranges(queries, ranges, nq), candidates, nq, nc).applyInArrow(selected(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(key), "score")
