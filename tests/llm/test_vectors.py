"""Nearest neighbours and exact top-k against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from preciario.llm import hnsw, neighbours, queries, topk
from tests.comparing import connect, differences
from tests.llm.data import random_vectors, vectors

SF = "/root/testdata/sf0.01"


def valid(rows):
    return {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}


def padded(rows):
    width = max(len(v) for v in rows.values())
    return list(rows), np.array([np.pad(v, (0, width - len(v))) for v in rows.values()])


def nearest_of(rows, is_query, k):
    own = {i: v for i, v in valid(rows).items() if (v != 0).any()}
    ids, x = padded(own)
    return {q: sorted((float(np.sqrt(((x[j] - x[n]) ** 2).sum())), i) for n, i in enumerate(ids) if i != q)[:k] for j, q in enumerate(ids) if is_query(q)}


def test_levels_and_links():
    x = random_vectors(1500, 16).astype(np.float64)
    graph = hnsw.Graph(x, hnsw.levels_of(len(x))).build()
    found = graph.search(x[:100], 64)
    true = np.argsort(((x[:100, None] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(true, found[:, :20], strict=True)]) > 0.95
    assert all((level < len(x)).all() for level in graph.links) and len(graph.links) > 1


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_graphs(n):
    x = random_vectors(n, 4).astype(np.float64)
    found = hnsw.Graph(x, hnsw.levels_of(n)).build().search(x, 64)
    assert [sorted(i for i in line if i >= 0) for line in found.tolist()] == [list(range(n))] * n


AWKWARD = [(0, [1, 2, 3]), (100, [1, 2, 3]), (200, None), (300, [1, None, 2]), (400, [0, 0, 0]), (500, [float("nan"), 1, 1]), (600, [float("inf"), 1, 1]), (None, [1, 1, 1])]
AWKWARD += [(700, [1, 2]), (701, []), (101, [1, 2, 3]), (101, [1, 2, 3]), (102, [-5.5, 0.25, 3])] + [(1000 + i, [1, 2, 3]) for i in range(40)]


def test_awkward_neighbours(spark):
    got = neighbours.nearest(vectors(spark, AWKWARD), lambda i: i % 100 == 0).collect()
    want = nearest_of(AWKWARD, lambda i: i % 100 == 0, 10)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == {(q, n + 1, i, s) for q, best in want.items() for n, (s, i) in enumerate(best)}
    assert neighbours.nearest(vectors(spark, []), lambda i: i % 100 == 0).count() == 0
    assert neighbours.nearest(vectors(spark, [(100, [1, 2])]), lambda i: i % 100 == 0).count() == 0


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rows = list(enumerate(random_vectors(1200, 16).tolist()))
    frame = neighbours.usable(vectors(spark, rows), "vec_id", "embedding")
    index = neighbours.build_index(frame, shard=300)
    assert index.count() == 4 and index.agg({"n": "sum"}).first()[0] == 1200
    got = neighbours.search_index(index, frame.where("id % 50 = 0")).collect()
    want = nearest_of(rows, lambda i: i % 50 == 0, 10)
    hits = sum((r.id in {i for _, i in want[r.query_id]}) for r in got)
    assert hits / sum(map(len, want.values())) > 0.97


def test_recall_of_whole_shards(spark):
    """Over three shards of full size, against brute force."""
    x = random_vectors(3 * neighbours.SHARD, 48, seed=9)
    frame = neighbours.usable(vectors(spark, list(enumerate(x.tolist()))), "vec_id", "embedding")
    index = neighbours.build_index(frame)
    assert index.agg({"n": "max"}).first()[0] > 0.95 * neighbours.SHARD and index.count() == 3
    asked = list(range(0, len(x), 500))
    got = neighbours.search_index(index, frame.where("id % 500 = 0")).collect()
    wide = x.astype(np.float64)
    hits = 0
    for q in asked:
        off = ((wide - wide[q]) ** 2).sum(axis=1)
        off[q] = np.inf
        hits += len(set(np.argsort(off, kind="stable")[:10].tolist()) & {r.id for r in got if r.query_id == q})
    assert hits / (10 * len(asked)) >= 0.9


def test_op1_recall(spark):
    got = queries.QUERIES["op1_neighbours"](spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = nearest_of(rows, lambda i: i % 100 == 0, 10)
    assert len(got) == sum(map(len, want.values()))
    assert sum((r.vec_id in {i for _, i in want[r.query_id]}) for r in got) / len(got) >= 0.95
    exact = {(q, i): s for q, best in want.items() for s, i in best}
    assert all(exact.get((r.query_id, r.vec_id), r.score) == r.score for r in got)


def top_of(rows, is_query, k, scale=64):
    own = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in own), default=0)
    own = [(i, v + [0] * (width - len(v))) for i, v in own]
    out = []
    for q, v in {i: v for i, v in own if is_query(i)}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in own if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_awkward_top_k(spark, monkeypatch):
    is_query = lambda i: i % 100 == 0
    for size in (8192, 8):
        monkeypatch.setattr(topk, "CANDIDATES", size)
        got = topk.top_k(vectors(spark, AWKWARD), is_query).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == top_of(AWKWARD, is_query, 20)
    assert topk.top_k(vectors(spark, []), is_query).count() == 0
    assert topk.top_k(vectors(spark, [(100, [1, 2])]), is_query).count() == 0


def test_large_components(spark):
    rows = [(i, [v, -v, 1.5]) for i, v in enumerate([1e7, 3e6 + 0.5, -2e7, 4e6, 1e-3, 1.7e7])]
    got = topk.top_k(vectors(spark, rows, "double"), lambda i: i >= 0, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == top_of(rows, lambda i: True, 3)


def test_op3_equals_oracle(spark):
    assert differences(queries.QUERIES["op3_topk"](spark, SF), connect(SF), queries.ORACLES["op3_topk"]) == []
