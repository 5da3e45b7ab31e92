"""Small tables with the awkward cases of every operator: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import random

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, line string, label int, score double, v string, class int"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns only clash with names used inside."""
    return spark.createDataFrame([(i, t, la, s, len(t) if t else None, "x", "y", 1, 0.5, "z", 2) for i, t, la, s in rows], DOCS)


def prose(seed: int, n: int, words=("ab", "cde", "fgh", "ij", "klm", "nop", "qr", "stu", "vwx", "yz")) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n))


AWKWARD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \n\t ", None, "a"),
    (4, "one", "en", "b"),
    (5, "One two", None, None),
    (None, "no key here at all", "en", "c"),
    (6, "naïve café 日本語 🙂 <|endoftext|> it's 12½ \r\n\n  x", "fr", "a"),
    (7, "repeat me please now", "en", "b"),
    (7, "repeat me please now", "en", "b"),
    (8, prose(1, 30000), "de", "c"),
]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], 3, "q") for i, v in rows], f"vec_id long, embedding array<{kind}>, id int, block string"
    )


def random_vectors(n: int, width: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, width)) + 2 * rng.normal(size=(8, width))[rng.integers(0, 8, n)]).astype(np.float32)
