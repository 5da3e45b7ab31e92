"""Token counts of sections: whole texts are encoded once, tokens are attributed afterwards.

Encoding each section by itself gives other tokens at every boundary.  Here the
whole text is encoded; each token has the span of characters its bytes come
from, and the spans are joined to the sections' spans by a search over their
sorted starts.  Rule for boundaries: **a token belongs to the section in which
its first character lies**; a character that is split over several tokens lends
its place to each of them.  So the counts of a text's sections add up to the
tokens of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preciario.llm.bpe import codec
from preciario.llm.shared import ddl

COUNTED = "section long, start long, end long, n_tokens long, n_crossing long"


def token_spans(text: str, ids: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of every token of a text; ``lengths``: bytes of each id."""
    ends = np.cumsum(lengths[np.frombuffer(ids, np.uint32)])
    starts = ends - lengths[np.frombuffer(ids, np.uint32)]
    if len(text) == (ends[-1] if len(ends) else 0):
        return starts, ends - 1
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1]


def line_starts(text: str) -> list[int]:
    """Sections by lines: each begins after a line break, which belongs to the line it ends."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def section_counts(
    df: DataFrame, rank_file: str, text: str = "text", starts: str | None = None, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row per section: ``keep``, section (from 0), start and end (characters, end exclusive),
    n_tokens, n_crossing (those of n_tokens that end in a later section).

    ``starts`` names a column with the ascending first characters of the sections, the first of
    them 0; without it lines are the sections.  A null or empty text is one section of no tokens.
    Repeated rows are counted each by itself; null keys are kept; other columns are not read.
    """
    schema = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, library=True)
        lengths = np.array([len(x) for x in own.vocabulary], np.int64)
        for batch in batches:
            texts = [x or "" for x in batch.column("__text").to_pylist()]
            given = batch.column("__starts").to_pylist() if starts else None
            rows, parts = [], []
            for i, x in enumerate(texts):
                begin = np.array((given[i] if given else None) or line_starts(x), np.int64)
                first, last = token_spans(x, own.encode(x), lengths)
                place = np.searchsorted(begin, first, "right") - 1
                crossing = place[np.searchsorted(begin, last, "right") - 1 > place]
                n = len(begin)
                rows.append(np.full(n, i))
                parts.append((np.arange(n), begin, np.append(begin[1:], len(x)), np.bincount(place, minlength=n), np.bincount(crossing, minlength=n)))
            take = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            columns = [batch.column(i).take(take) for i in range(len(keep))]
            columns += [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) if parts else pa.array([], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "section", "start", "end", "n_tokens", "n_crossing"])

    chosen = [*keep, F.col(text).alias("__text"), *([F.col(starts).alias("__starts")] if starts else [])]
    return df.select(*chosen).mapInArrow(run, f"{ddl(schema)}, {COUNTED}")
