"""What the vector operators share: valid vectors, and blocks of them as flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PACKED = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("width", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def packed(rows: DataFrame, block: Column, key: str, vector: str) -> DataFrame:
    """One row per block: block, n, width, ids (longs, ascending) and vectors (doubles), as flat bytes."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = matrix(table.column("vector"))
        values = [table.column("block")[0].as_py(), len(ids), x.shape[1], ids[order].astype(np.int64).tobytes(), x[order].tobytes()]
        return pa.table([pa.array([v], f.type) for v, f in zip(values, PACKED, strict=True)], schema=PACKED)

    chosen = rows.select(block.cast("long").alias("block"), F.col(key).alias("id"), F.col(vector).alias("vector"))
    return chosen.groupBy("block").applyInArrow(run, "block long, n long, width long, ids binary, vectors binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["width"])


def blocks_of(n: int, size: int) -> int:
    return max(1, -(-n // size))
