"""The quality classifier: features, log ratios, dual coordinate descent, whole predictions, held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from preciario.llm import quality_classifier as Q
from preciario.llm import queries
from tests.llm.data import AWKWARD, documents, prose

SF = "/root/testdata/sf0.1"


def held(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 4 == 2


def test_features_are_sets_of_whole_texts():
    assert Q.ngrams(None).tolist() == Q.ngrams("").tolist() == []
    assert set(Q.ngrams("ab cd")) < set(Q.ngrams("ab cd ef"))
    assert Q.ngrams("ab ab ab").tolist() == Q.ngrams("ab ab ab ab").tolist()  # indicators, not counts
    assert set(Q.ngrams("x y")) != set(Q.ngrams("X y"))
    long = "word " * 200000
    assert set(Q.ngrams(long)) < set(Q.ngrams(long + "end\ud800"))


def test_dual_coordinate_descent_reaches_the_optimum():
    """Primal and dual value of the fitted model meet."""
    rng = np.random.default_rng(3)
    labels = np.where(rng.random(120) < 0.3, 1, -1)
    vectors = []
    for y in labels:
        at = np.sort(rng.choice(40, 8, replace=False))
        x = rng.normal(size=8) + 0.6 * y
        vectors.append((at, x / np.sqrt(x @ x)))
    weights = Q.fit(vectors, labels, epochs=400, cost=0.5)
    share = {y: len(labels) / (2 * (labels == y).sum()) for y in (1, -1)}
    margins = np.array([weights[at] @ x + weights[-1] for at, x in vectors])
    hinge = np.maximum(0, 1 - labels * margins) * np.array([0.5 * share[y] for y in labels.tolist()])
    primal = weights @ weights / 2 + hinge.sum()
    for _ in range(200):  # no small step does better
        other = weights + rng.normal(size=len(weights)) * 0.01 * (np.arange(len(weights)) < 40)
        margins = np.array([other[at] @ x + other[-1] for at, x in vectors])
        assert other @ other / 2 + (np.maximum(0, 1 - labels * margins) * np.array([0.5 * share[y] for y in labels.tolist()])).sum() >= primal - 1e-6


def test_sigmoid_is_calibrated():
    rng = np.random.default_rng(4)
    margins = rng.normal(size=4000)
    labels = np.where(rng.random(4000) < 1 / (1 + np.exp(-(2.5 * margins - 0.7))), 1, -1)
    slope, intercept = Q.sigmoid(margins, labels, np.ones(4000))
    assert abs(slope - 2.5) < 0.25 and abs(intercept + 0.7) < 0.2
    assert Q.sigmoid(margins[:3], np.ones(3, int), np.ones(3)) == (1.0, 0.0)


def rows(n):
    bad = [(i, f"BUY!! NOW!! {prose(i, 20)} !!", "en", "a") for i in range(0, n, 2)]
    return bad + [(i, prose(i, 60), "en", "b") for i in range(1, n, 2)]


def test_training_equals_plain_python(spark):
    own = [*rows(300), *AWKWARD[:-1]]
    docs = documents(spark, own)
    marks = [(i, int(t is not None and "!!" not in t), 1) for i, t, _, _ in own if i != 299]
    labels = spark.createDataFrame([*marks, (3, 0, 0), (9, 1, 0), (9, 0, 0), (11, None, 1), (None, 1, 1), (777777, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    votes: dict = {}
    for i, q in [(m[0], m[1]) for m in marks] + [(3, 0), (9, 1), (9, 0)]:
        if i is not None:
            votes.setdefault(i, []).append(q)
    good = {i: np.mean(v) > 0.5 for i, v in votes.items() if np.mean(v) != 0.5}
    taught = [(t or "", bool(good[i])) for i, t, _, _ in own if i in good and not held(i)]
    counts = np.zeros((2, Q.FEATURES))
    for t, y in taught:
        counts[int(y), Q.ngrams(t)] += 1
    n = [sum(y == k for _, y in taught) for k in (False, True)]
    assert np.allclose(model.ratios, np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2)))
    scores = {(r.doc_id, r.score, r.predicted) for r in Q.scored(docs, model).collect()}
    assert scores == {(i, model.score(t), int(model.score(t) >= Q.KEEP)) for i, t, _, _ in own}
    fresh = [(f"BUY!! NOW!! {prose(5000 + k, 20)} !!", 0) if k % 2 else (prose(6000 + k, 60), 1) for k in range(60)]
    assert np.mean([int(model.score(t) >= 0.5) == y for t, y in fresh]) == 1.0


def test_held_out_rows_teach_nothing(spark):
    docs = documents(spark, rows(200))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    flipped = spark.createDataFrame([(i, 1 - i % 2 if held(i) else i % 2) for i in range(200)], "doc_id long, quality int")
    a, b = Q.train(docs, labels), Q.train(docs, flipped)
    assert (a.ratios == b.ratios).all() and (a.weights == b.weights).all() and a.slope == b.slope


@pytest.mark.parametrize(("marks", "score"), [([], 0.5), ([1] * 50, None), ([0] * 50, None)])
def test_without_two_classes(spark, marks, score):
    docs = documents(spark, rows(50))
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    n = sum(not held(i) for i in range(len(marks)))
    want = score if score is not None else ((n if marks[0] else 0) + 1) / (n + 2)
    found = Q.scored(docs, Q.train(docs, labels)).select("score").distinct().collect()
    assert [r.score for r in found] == [want]
    empty = docs.where(F.lit(False))
    assert Q.scored(empty, Q.train(empty, labels)).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    docs = documents(spark, [*AWKWARD, *rows(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    found = Q.scored(docs, Q.train(docs, labels), keep=("doc_id", "score", "label"), names=("s", "p")).collect()
    assert len(found) == len(AWKWARD) + 60 and all(0 <= r.s <= 1 and r.score == 0.5 for r in found)


def test_op11_whole_table_and_held_out_accuracy(spark):
    found = {r.doc_id: r for r in queries.QUERIES["op11_quality"](spark, SF).collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in found.items())
    marks = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held(r.doc_id)]
    good = [found[r.doc_id].predicted for r in marks if r.quality == 1]
    bad = [found[r.doc_id].predicted for r in marks if r.quality == 0]
    assert len(bad) > 50 and np.mean(good) > 0.99 and np.mean(bad) < 0.05
