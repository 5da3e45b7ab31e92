"""Cost-balanced packing of documents into sequences of a fixed length.

A sequence costs ``LINEAR * length`` for each piece plus ``QUADRATIC * length**2``
for the attention inside it.  Documents are packed in windows of a task's own
rows: whole lengths go off as full sequences, the remainders are taken in
descending order, each to the sequence of lowest cost that still has room; if no
sequence has room for all of it, it is cut.  A window opens as many sequences as
its remainders fill, so at most one sequence of a window is padded.  Windows are
bounded and nothing is shuffled, so hot keys and the size of the input don't
matter.  Sequence numbers hold the task's partition and a counter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from preciario.llm.bpe import codec
from preciario.llm.shared import ddl

LENGTH = 1024
LINEAR, QUADRATIC = 1024.0, 1.0
#: Remainders packed together.
WINDOW = 4096
#: Ids held in a window at most; a window also ends here.
WINDOW_IDS = 4_000_000

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: np.ndarray, size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(item, start in item, length, sequence, offset) for items shorter than a sequence."""
    total = int(lengths.sum())
    n = -(-total // size)
    room = np.full(n, size, np.int64)
    if total % size:
        room[-1] = total % size
    left, cost, out = room.copy(), np.zeros(n), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        start, rest = 0, int(lengths[item])
        while rest:
            fits = np.where(left >= rest, cost, np.inf)
            at = int(fits.argmin())
            if left[at] < rest:  # no sequence takes all of it: fill the widest room
                at = int(left.argmax())
            put = min(rest, int(left[at]))
            out.append((item, start, put, at, int(room[at] - left[at])))
            left[at] -= put
            cost[at] += LINEAR * put + QUADRATIC * put * put
            start, rest = start + put, rest - put
    return out


class Window:
    def __init__(self, size: int):
        self.size, self.rows, self.ids, self.held = size, [], [], 0

    def add(self, row: int, ids: bytes) -> None:
        self.rows.append(row)
        self.ids.append(ids)
        self.held += len(ids) // 4

    def pieces(self, first: int) -> tuple[list[tuple], int]:
        """(row, start, length, crc, tokens, sequence, offset) of all pieces, and the next number."""
        size, out, number = self.size, [], first
        rests = np.zeros(len(self.ids), np.int64)
        for i, (row, ids) in enumerate(zip(self.rows, self.ids, strict=True)):
            n = len(ids) // 4
            for start in range(0, n - n % size, size):
                out.append((row, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, number, 0))
                number += 1
            rests[i] = n % size
        last = number
        for item, start, length, sequence, offset in assign(rests, size):
            ids = self.ids[item]
            n = len(ids) // 4
            at = n - n % size + start
            out.append((self.rows[item], at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, number + sequence, offset))
            last = max(last, number + sequence + 1)
        return out, last


def pack(
    df: DataFrame,
    rank_file: str,
    special: tuple[tuple[str, int], ...] = (),
    end: int = 0,
    size: int = LENGTH,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone.  Repeated rows and
    rows without a key are documents of their own.  Other columns are not read.
    """
    schema = StructType(df.select(F.col(key)).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, special=special, library=True)
        stop = int(end).to_bytes(4, "little")
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

        def closed(keys: pa.Array, window: Window, number: int) -> tuple[pa.RecordBatch, int]:
            pieces, number = window.pieces(number)
            columns = list(zip(*pieces, strict=True))
            arrays = [keys.take(pa.array(columns[0], pa.int64()))] + [pa.array(c, pa.int64()) for c in columns[1:]]
            return pa.RecordBatch.from_arrays(arrays, [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), number

        keys, window = [], Window(size)
        for batch in batches:
            for i, x in enumerate(batch.column(1).to_pylist()):
                window.add(len(keys), own.encode(x or "") + stop)
                keys.append(batch.column(0)[i].as_py())
                if len(keys) >= WINDOW or window.held >= WINDOW_IDS:
                    out, number = closed(pa.array(keys, batch.schema.field(0).type), window, number)
                    yield out
                    keys, window = [], Window(size)
            kind = batch.schema.field(0).type
        if keys:
            yield closed(pa.array(keys, kind), window, number)[0]

    return df.select(key, text).mapInArrow(run, f"{ddl(schema)}, {PIECES}")
