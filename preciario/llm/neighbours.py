"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged.

Equal vectors are one node; it carries the ``k + 1`` smallest ids among them, all
that any list of ``k`` can need.  Nodes are dealt over shards by a hash of the vector, each
shard's graph is built in one task and written as flat arrays; every block of
queries meets every shard, and the shards' lists are merged by distance and id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from preciario.llm.hnsw import SEARCH_WIDTH, Graph, levels_of
from preciario.llm.shared import written
from preciario.llm.topk import block, grid
from preciario.llm.vectors import blocks_of, finite, matrix, packed, unpacked, widened

K = 10
#: Distinct vectors of a shard, and queries of a block.
SHARD = 8192
QUERIES = 1024
SLICE = 256

INDEX = pa.schema(
    [("block", pa.int64()), ("n", pa.int64()), ("width", pa.int64()), ("vectors", pa.binary()), ("levels", pa.binary()), ("links", pa.list_(pa.binary())), ("offsets", pa.binary()), ("ids", pa.binary())]
)
FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def build_shard(table: pa.Table) -> pa.Table:
    """The index row of one shard: vectors, levels, flat neighbour arrays per level, and the nodes' ids."""
    order = pa.compute.sort_indices(table.column("first"))  # the graph doesn't depend on the order of arrival
    table = table.take(order)
    x = matrix(table.column("v"))
    graph = Graph(x, levels_of(len(x))).build()
    members = table.column("ids").combine_chunks()
    ids = members.flatten().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    row = [
        table.column("block")[0].as_py(), len(x), x.shape[1], x.tobytes(), graph.levels.tobytes(),
        [level.tobytes() for level in graph.links], offsets.tobytes(), ids.astype(np.int64).tobytes(),
    ]
    return pa.table([pa.array([v], f.type) for v, f in zip(row, INDEX, strict=True)], schema=INDEX)


def search_shard(k: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            queries, asked = unpacked(left.slice(0, 1).to_pylist()[0])
            index = right.slice(0, 1).to_pylist()[0]
            n = index["n"]
            x = np.frombuffer(index["vectors"], np.float64).reshape(n, index["width"])
            links = [np.frombuffer(level, np.int32).reshape(n, -1) for level in index["links"]]
            dimension = max(x.shape[1], asked.shape[1])
            x, asked = widened(x, dimension), widened(asked, dimension)
            graph = Graph(x, np.frombuffer(index["levels"], np.int64), links)
            offsets, ids = np.frombuffer(index["offsets"], np.int64), np.frombuffer(index["ids"], np.int64)
            for at in range(0, len(queries), SLICE):
                for q, vector, nodes in zip(queries[at : at + SLICE], asked[at : at + SLICE], graph.search(asked[at : at + SLICE], width), strict=True):
                    nodes = nodes[nodes >= 0]
                    off = x[nodes] - vector
                    score = np.sqrt((off * off).sum(axis=1))
                    sizes = offsets[nodes + 1] - offsets[nodes]
                    every = np.concatenate([ids[offsets[i] : offsets[i + 1]] for i in nodes]) if len(nodes) else np.zeros(0, np.int64)
                    score = np.repeat(score, sizes)
                    score, every = score[every != q], every[every != q]
                    best = np.lexsort((every, score))[:k]
                    out[0].append(np.full(len(best), q))
                    out[1].append(every[best])
                    out[2].append(score[best])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, kinds, strict=True)], schema=FOUND)

    return run


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of the rows that take part, once each."""
    there = finite(F.col(vector)) & F.exists(vector, lambda x: x != 0) & F.col(key).isNotNull()
    return vectors.where(there).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).dropDuplicates(["id", "v"])


def build_index(rows: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """One row per shard, written to the shared folder; ``rows`` as from ``usable``."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = written(nodes, "nodes")
    shards = blocks_of(nodes.count(), shard)
    dealt = nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("long").alias("block"), "v", "ids", F.col("ids")[0].alias("first"))
    schema = "block long, n long, width long, vectors binary, levels binary, links array<binary>, offsets binary, ids binary"
    return written(dealt.groupBy("block").applyInArrow(build_shard, schema), "index")


def search_index(index: DataFrame, asked: DataFrame, k: int = K, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, id and score of each query's ``k`` nearest found; ``asked`` has id and v."""
    nq, shards = blocks_of(asked.count(), QUERIES), index.agg(F.max("block")).first()[0]
    queries = written(packed(asked, block(nq), "id", "v"), "queries")
    found = grid(queries, index, nq, (shards or 0) + 1).applyInArrow(search_shard(k, width), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), key and score (Euclidean distance, double) of each query's ``k`` nearest found.

    Candidates are all rows but those with the query's own id; ties go to the smaller id; with fewer than
    ``k`` candidates all are returned.  Vectors that are null, zero (or empty) or hold null or non-finite
    components, and rows without id, take no part; a shorter vector counts as filled up with zeros.
    Repeated rows count once; of several vectors under one id the smallest is asked.  Other columns are not read.
    """
    rows = usable(vectors, key, vector)
    asked = written(rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")), "asked")
    found = search_index(build_index(rows, k), asked, k)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")
