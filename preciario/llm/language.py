"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Document frequencies of hashed character 1- to 3-grams are counted over *all*
   training rows.
2. The weights are fitted on a bounded sample, ``PER_LANGUAGE`` rows of each
   language (those of the smallest hash), by follow-the-regularised-leader with
   L1 and L2 penalties; L1 leaves most weights at exactly zero.
3. A fifth of the sample takes no part in fitting; on it one temperature is fitted
   that turns scores into calibrated probabilities.
4. Every whole text is scored; nothing but the text enters a prediction.

What passes the driver is bounded by the number of languages: one cut-off and
``FEATURES`` weights each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.llm.shared import ddl

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: Bound on the fitting sample: rows of each language.
PER_LANGUAGE = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
CALIBRATION = 5
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_SALTS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and their numbers."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    rolling = np.zeros(len(points), np.uint32)
    for order in ORDERS:
        if len(points) < order:
            break
        rolling = (rolling[: len(points) - order + 1] ^ points[order - 1 :]) * np.uint32(0x01000193) + np.uint32(order)
        found.append(((rolling * _SALTS[order - 1]) >> np.uint32(16)).astype(np.int32))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    table = np.bincount(np.concatenate(found), minlength=FEATURES)
    features = np.flatnonzero(table)
    return features, table[features]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their TF-IDF values, of unit length."""
    features, n = counts(text)
    values = (1.0 + np.log(n)) * idf[features]
    norm = np.sqrt((values * values).sum())
    return features, values / norm if norm else values


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: np.ndarray, n_classes: int, idf: np.ndarray) -> np.ndarray:
    """Weights (features + 1 for the intercept, classes) by follow-the-regularised-leader."""
    z = np.zeros((FEATURES + 1, n_classes))
    n = np.zeros_like(z)

    def weights(rows):
        zr, nr = z[rows], n[rows]
        return np.where(np.abs(zr) <= L1, 0.0, (np.sign(zr) * L1 - zr) / ((BETA + np.sqrt(nr)) / ALPHA + L2))

    vectors = [vector(x, idf) for x in texts]
    for _ in range(EPOCHS):
        for (features, values), label in zip(vectors, labels, strict=True):
            rows, x = np.append(features, FEATURES), np.append(values, 1.0)
            w = weights(rows)
            error = softmax(x @ w)
            error[label] -= 1.0
            gradient = x[:, None] * error
            squared = n[rows] + gradient * gradient
            z[rows] += gradient - (np.sqrt(squared) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] = squared
    return weights(slice(None))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores with the least cross entropy, by golden section on its logarithm."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(scores / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(key: Column) -> Column:
    """Rows whose key, as text, has a CRC-32 of remainder 1 by 3; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def document_frequencies(rows: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of texts and, for each feature, of texts that have it; one partial count per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total[counts(x)[0]] += 1
                total[FEATURES] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    summed = rows.select(text).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for feature, n in summed.collect():  # at most FEATURES + 1 rows
        out[feature] = n
    return int(out[FEATURES]), out[:FEATURES]


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.heat = languages, idf, heat
        self.weights = weights

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        features, values = vector(text, self.idf)
        p = softmax((values @ self.weights[features] + self.weights[-1]) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """A model of the rows that are not held out and have text and label."""
    rows = docs.where(~held_out(F.col(key)) & F.col(text).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.xxhash64(F.col(key).cast("string"), F.lit(42)).alias("at"), F.col(text).alias("text"), F.col(label).alias("label"))
    # the share of all hashes that holds a little more than PER_LANGUAGE rows of a language
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    cuts = {r.label: min(2**63 - 1, int((1.2 * PER_LANGUAGE + 100) / r.n * 2**64) - 2**63) for r in sizes}
    languages = sorted(cuts)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)
    total, frequencies = document_frequencies(rows)
    idf = np.log((1.0 + total) / (1.0 + frequencies)) + 1.0
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, at, seen = [], [], [], {}
        for batch in batches:
            for x, y, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts.append(x)
                labels.append(number[y])
                at.append(h)
        order = sorted(range(len(texts)), key=lambda i: (at[i], texts[i]))
        chosen = []
        for i in order:
            seen[labels[i]] = seen.get(labels[i], 0) + 1
            if seen[labels[i]] <= PER_LANGUAGE:
                chosen.append(i)
        own = [i for k, i in enumerate(chosen) if k % CALIBRATION]
        rest = [i for k, i in enumerate(chosen) if k % CALIBRATION == 0]
        weights = fit([texts[i] for i in own], np.array([labels[i] for i in own], np.int64), len(languages), idf)
        held = [vector(texts[i], idf) for i in rest]
        scores = np.array([v @ weights[f] + weights[-1] for f, v in held]).reshape(-1, len(languages))
        heat = temperature(scores, np.array([labels[i] for i in rest], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()]), pa.array([heat])], ["weights", "heat"])

    cutoffs = F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    drawn = rows.where(F.col("at") <= cutoffs[F.col("label")])
    sample = drawn.groupBy("label", "at").agg(F.min("text").alias("text")).select("text", "label", "at").repartition(1)  # repeated rows count once
    found = sample.mapInArrow(run, "weights binary, heat double").first()
    weights = np.frombuffer(found.weights, np.float32).reshape(FEATURES + 1, len(languages)).astype(np.float64)
    return Model(languages, idf, weights, found.heat)


def identify(
    docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``keep``, lang_pred and score (0 to 1; ``names`` are their names) of every whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if there was
    nothing to learn from.  One row out for each row in, repeated rows included; null keys are kept.
    """
    kept = docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: FEATURES x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(x) for x in batch.column("__text").to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{ddl(kept.schema)}, `{names[0]}` string, `{names[1]}` double")
