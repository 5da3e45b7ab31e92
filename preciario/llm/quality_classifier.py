"""Text quality by naive Bayes support vectors.

1. A text is the set of its n-grams: hashed character 1- to 4-grams with their case, words, pairs of words, and runs of
   one word.  Document counts of every n-gram by class are taken over *all* labelled training rows.
2. The indicator of an n-gram is scaled by the log ratio of its counts in the classes, and the vector to unit length; a text
   that is fitted on is left out of the counts that scale it.
3. A linear hinge-loss model is fitted by dual coordinate descent on a bounded sample, ``PER_CLASS`` rows of each class
   (those of the smallest hash), and interpolated with naive Bayes, as published for such models.
4. A fifth of the sample takes no part in fitting; on it a sigmoid turns margins into probabilities, with the classes
   weighted as they are in all training rows.

What passes the driver is bounded: two counts and one weight for each of ``FEATURES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.llm.jaccard_join import mixed, word_hashes
from preciario.llm.shared import ddl, discard, written

FEATURES = 1 << 17
ORDERS = (1, 2, 3, 4)
#: Runs of one word that are n-grams of their own.
RUNS = (2, 3, 5, 9)
#: Bound on the fitting sample: rows of each class.
PER_CLASS = 2000
EPOCHS, COST, SMOOTH = 12, 1.0, 1.0
#: Share of the linear model in its interpolation with naive Bayes.
SUPPORT = 0.25
CALIBRATION = 5
#: From this score on a text is predicted to be of label 1.
KEEP = 0.7

_SALTS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F))
_SHIFT = np.uint32(32 - FEATURES.bit_length() + 1)
_WIDE = np.uint64(64 - FEATURES.bit_length() + 1)


def ngrams(text: str | None) -> np.ndarray:
    """The distinct features of a whole text, ascending."""
    found = np.zeros(FEATURES, bool)
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    rolling = np.zeros(len(points), np.uint32)
    for order, salt in zip(ORDERS, _SALTS, strict=True):
        if len(points) < order:
            break
        rolling = (rolling[: len(points) - order + 1] ^ points[order - 1 :]) * np.uint32(0x01000193) + np.uint32(order)
        found[(rolling * salt) >> _SHIFT] = True
    words = word_hashes((text or "").encode("utf-8", "replace").decode())
    found[words >> _WIDE] = True
    if len(words) > 1:
        found[mixed(words[:-1] * np.uint64(3) + words[1:]) >> _WIDE] = True
        changes = np.flatnonzero(np.diff(words) != 0)
        longest = int(np.diff(np.concatenate([[-1], changes, [len(words) - 1]])).max())
        runs = np.array([run for run in RUNS if run <= longest], np.uint64)
        found[mixed(runs) >> _WIDE] = True
    return np.flatnonzero(found)


def log_ratios(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """log of an n-gram's share in the texts of label 1, over that in the others."""
    return np.log((positive + SMOOTH) / (n_positive + 2 * SMOOTH)) - np.log((negative + SMOOTH) / (n_negative + 2 * SMOOTH))


def vector(text: str | None, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their values, of unit length."""
    at = ngrams(text)
    return at, unit(ratios[at])


def unit(values: np.ndarray) -> np.ndarray:
    norm = np.sqrt((values * values).sum())
    return values / norm if norm else values


def taught_vector(text: str | None, good: bool, counts: np.ndarray, n: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """As ``vector``, of a text that is itself among the ``counts`` (bad, good) of ``n`` texts, without its own share in them.

    Otherwise n-grams of one text would tell its label, and neither weights nor margins of the sample would be those of new texts.
    """
    at = ngrams(text)
    bad, fine = counts[0, at] - (not good), counts[1, at] - good
    return at, unit(log_ratios(fine, bad, n[1] - good, n[0] - (not good)))


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights, the last one of the intercept, by dual coordinate descent; labels are 1 or -1, classes count alike."""
    weights, dual = np.zeros(FEATURES + 1), np.zeros(len(labels))
    share = {y: len(labels) / (2 * max(1, int((labels == y).sum()))) for y in (1, -1)}
    most = np.array([cost * share[y] for y in labels.tolist()])
    curvature = np.array([1.0 + float(x @ x) for _, x in vectors])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(labels)).tolist():
            at, x = vectors[i]
            slope = labels[i] * (weights[at] @ x + weights[-1]) - 1.0
            after = min(max(dual[i] - slope / curvature[i], 0.0), most[i])
            step = (after - dual[i]) * labels[i]
            if step:
                dual[i] = after
                weights[at] += step * x
                weights[-1] += step
    return weights


def towards_mean(weights: np.ndarray, share: float = SUPPORT) -> np.ndarray:
    """Between the mean magnitude of all weights, which is naive Bayes, and the weights themselves."""
    return (1 - share) * np.abs(weights).mean() + share * weights


def sigmoid(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability of label 1, by Newton steps on smoothed targets; labels are 1 or -1."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    n = np.array([(labels == -1).sum(), (labels == 1).sum()])
    target = np.where(labels == 1, (n[1] + 1.0) / (n[1] + 2.0), 1.0 / (n[0] + 2.0))
    rows = np.stack([margins, np.ones_like(margins)], 1)
    at = np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        z = rows @ v
        return float((weight * (np.logaddexp(0.0, z) - target * z)).sum() + 1e-6 * v @ v)

    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ at, -500, 500)))
        gradient = rows.T @ (weight * (p - target)) + 2e-6 * at
        step = np.linalg.solve(rows.T @ (rows * (weight * p * (1 - p))[:, None]) + 2e-6 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


@dataclass
class Model:
    """``ratios`` scale indicators, ``weights`` (the last one an intercept) give margins, the sigmoid probabilities."""

    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    intercept: float
    prior: float | None

    def score(self, text: str | None) -> float:
        """The probability of label 1; without two classes to learn from, the share of label 1."""
        if self.prior is not None:
            return self.prior
        at, values = vector(text, self.ratios)
        margin = self.weights[at] @ values + self.weights[-1]
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.intercept, -500, 500))))


def held_out(key: Column) -> Column:
    """Rows whose key, as text, has a CRC-32 of remainder 2 by 4; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """at (hash of the key), text and good (whether of label 1) of the rows that are not held out and have a label.

    Several labels of a key count by their majority, a draw as none; a null text is empty.
    """
    votes = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg((F.col(label) == 1).cast("double")).alias("share"))
    votes = votes.where(F.col("share") != 0.5).select(F.col(key).alias("__key"), (F.col("share") > 0.5).alias("good"))
    rows = docs.where(~held_out(F.col(key))).select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # texts move once, at every size: labels grow with the input and are never broadcast
    return rows.join(votes.hint("merge"), "__key").select(F.xxhash64(F.col("__key").cast("string"), F.lit(42)).alias("at"), "text", "good")


def class_counts(rows: DataFrame) -> np.ndarray:
    """For each feature, the texts of either class (bad, good) that have it; one partial count per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[int(good), ngrams(text)] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["feature", "bad", "good"])

    summed = rows.select("text", "good").mapInArrow(run, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found, out = summed.toArrow(), np.zeros((2, FEATURES), np.int64)  # at most FEATURES rows
    for i, name in enumerate(("bad", "good")):
        out[i, found.column("feature").to_numpy()] = found.column(name).to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of ``label`` (1 against the rest) from the rows that are not held out."""
    rows = written(labelled(docs, labels, key, text, label), "labelled")
    try:
        return _trained(rows)
    finally:
        discard(rows)


def _trained(rows: DataFrame) -> Model:
    sizes = {r.good: r.n for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_good, n_bad = sizes.get(True, 0), sizes.get(False, 0)
    nothing = np.zeros(FEATURES)
    if not n_good or not n_bad:
        return Model(nothing, np.zeros(FEATURES + 1), 1.0, 0.0, (n_good + 1) / (n_good + n_bad + 2))
    counts = class_counts(rows)
    ratios = log_ratios(counts[1], counts[0], n_good, n_bad)
    # the share of all hashes that holds a little more than PER_CLASS rows of a class
    cut_good, cut_bad = (min(2**63 - 1, int((1.2 * PER_CLASS + 100) / n * 2**64) - 2**63) for n in (n_good, n_bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = sorted((at, text, good) for batch in batches for at, text, good in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        chosen = [x for good in (True, False) for x in [r for r in drawn if r[2] == good][:PER_CLASS]]
        vectors = [taught_vector(x[1], x[2], counts, (n_bad, n_good)) for x in chosen]
        y = np.array([1 if x[2] else -1 for x in chosen])
        rest = np.arange(len(y)) % CALIBRATION == 0
        weights = fit([v for v, r in zip(vectors, rest.tolist(), strict=True) if not r], y[~rest])
        weights[:-1] = towards_mean(weights[:-1])
        margins = np.array([weights[at] @ x + weights[-1] for (at, x), r in zip(vectors, rest.tolist(), strict=True) if r])
        weight = np.where(y[rest] == 1, n_good / max(1, (y[rest] == 1).sum()), n_bad / max(1, (y[rest] == -1).sum()))
        slope, intercept = sigmoid(margins, y[rest], weight * rest.sum() / weight.sum())
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([slope]), pa.array([intercept])], ["weights", "slope", "intercept"])

    drawn = rows.where(F.col("at") <= F.when(F.col("good"), F.lit(cut_good)).otherwise(F.lit(cut_bad)))
    sample = drawn.distinct().select("at", "text", "good").repartition(1)  # bounded by PER_CLASS; repeated rows count once
    found = sample.mapInArrow(run, "weights binary, slope double, intercept double").first()
    return Model(ratios, np.frombuffer(found.weights), found.slope, found.intercept, None)


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep``, score (0 to 1, higher: label 1 likelier) and predicted (1 from ``KEEP`` on) of every whole text.

    A null text is scored as an empty one.  One row out for each row in, repeated rows and null keys included.
    """
    kept = docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(x) for x in batch.column("__text").to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(scores, pa.float64()), pa.array([int(x >= KEEP) for x in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{ddl(kept.schema)}, `{names[0]}` double, `{names[1]}` int")
