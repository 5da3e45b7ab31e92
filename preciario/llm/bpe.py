"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the merge result of its bytes exactly when every two
neighbours are the merge result of *their* bytes.  So the merges compile to a
nondeterministic transducer that reads bytes along a trie of the vocabulary and
may end a token there if the token before it is a fitting neighbour.
Every prefix has one such reading at most, so hypotheses die quickly, and the token
that ends at a byte follows from the state: states hold no output, a transition names
that token, and the tokens of a piece are read off backwards from its end.
Subset construction runs on demand: a state is made when a text
first reaches it and is kept for later texts (up to a number of states; then the
table starts anew, which costs time and changes nothing).
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preciario.llm.shared import ddl

#: States and cached pieces a worker keeps before it starts anew.
MOST_STATES = 150_000
MOST_PIECES = 300_000

#: Tokens below a trie node that are compared one by one.
FEW_TOKENS = 16

#: Later than any merge.
NEVER = 1 << 60

#: Letters and numbers of the first two Unicode blocks, for texts that have no other.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_SPACES = r" \t\n\r\f\v\x85\xa0"
_SHORT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
#: Characters whose class differs between pattern libraries never take the short way.
_OTHER = re.compile("[\x1c-\x1fĀ-\U0010ffff]")


def read_ranks(path: str) -> dict[bytes, int]:
    """The lines ``base64 rank`` of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encodes one piece of bytes; see the module's docstring."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append(-1)
            self.ends[node] = i
        self.fits: dict[int, bool] = {}
        self.kinds: dict[int, int] = {}
        self.kind_numbers: dict[tuple, int] = {(): 0}
        self.kind_parts: list[list] = [[]]
        self.edges: tuple[dict, dict] = ({}, {})
        self.few: dict[int, list[int] | None] = {}
        self.narrowed: dict[int, int] = {}
        self.alike: dict[tuple, int] = {}
        self.reset()

    def reset(self) -> None:
        #: hypotheses of a state, the earliest begun first: (kind of the token before, trie node);
        #: kind 0 fits everything and also stands for the beginning
        self.states: dict[tuple, int] = {}
        self.subsets: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.state(((0, 0),))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The merges by their definition: lowest rank first, leftmost among equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def history(self, token: int, left: bool) -> list[tuple[bytes, int]]:
        """The parts that stood at one edge of a token while it was merged, each with the
        rank of the merge that ended it; the token itself never ends."""
        memo = self.edges[left]
        if token in memo:
            return memo[token]
        ranks, whole = self.ranks, self.tokens[token]
        parts = [whole[i : i + 1] for i in range(len(whole))]
        out = []
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            if at == (0 if left else len(parts) - 2):
                out.append((parts[0 if left else -1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) > 1:
            raise ValueError(f"no merges lead to token {token}")
        out.append((whole, NEVER))
        memo[token] = out
        return out

    def kind(self, token: int) -> int:
        """Tokens of one kind have the same fitting successors: of the parts at the right
        edge only those matter that some longer token begins with."""
        known = self.kinds.get(token)
        if known is None:
            begins, right = -1, []
            for part, ends in self.history(token, False):
                node = 0
                for byte in part:
                    node = self.children[node].get(byte, -1)
                    if node < 0:
                        break
                if node >= 0 and self.children[node]:
                    right.append((part, begins, ends))
                begins = ends
            known = self.kinds[token] = self.kind_numbers.setdefault(tuple(right), len(self.kind_parts))
            if known == len(self.kind_parts):
                self.kind_parts.append(right)
        return known

    def neighbours(self, kind: int, token: int) -> bool:
        """Whether no merge ever crosses from a token of this kind into the next token.

        A merge crosses if two edge parts stand side by side at some time and have a rank
        that comes before what ends either.  Of two merges with one rank the left comes first.
        """
        key = kind << 32 | token
        known = self.fits.get(key)
        if known is None:
            known, begins = True, -1
            for y, ends in self.history(token, True):
                for x, x_begins, x_ends in self.kind_parts[kind]:
                    if x_begins <= ends and begins < x_ends:
                        crossing = self.ranks.get(x + y, NEVER)
                        if crossing != NEVER and crossing < x_ends and crossing <= ends:
                            known = False
                begins = ends
            if len(self.fits) >= 4 * MOST_STATES:
                self.fits.clear()
            self.fits[key] = known
        return known

    def below(self, node: int) -> list[int] | None:
        """The tokens that lie below a node, if they are few."""
        if node not in self.few:
            found, todo = [], [node]
            while todo and len(found) <= FEW_TOKENS:
                for child in self.children[todo.pop()].values():
                    todo.append(child)
                    if self.ends[child] >= 0:
                        found.append(self.ends[child])
            self.few[node] = found if len(found) <= FEW_TOKENS else None
        return self.few[node]

    def narrow(self, kind: int, node: int) -> int:
        """One kind for all that let the same tokens below a node follow: 0 if all fit, -1 if none does."""
        key = kind << 32 | node
        known = self.narrowed.get(key)
        if known is None:
            known, tokens = kind, self.below(node)
            if tokens is not None:
                fitting = tuple([t for t in tokens if self.neighbours(kind, t)])
                known = 0 if len(fitting) == len(tokens) else self.alike.setdefault((node, fitting), kind) if fitting else -1
            if len(self.narrowed) >= 4 * MOST_STATES:
                self.narrowed.clear()
            self.narrowed[key] = known
        return known

    def state(self, subset: tuple) -> int:
        number = self.states.get(subset)
        if number is None:
            number = self.states[subset] = len(self.subsets)
            self.subsets.append(subset)
            self.moves.append({})
        return number

    def move(self, number: int, byte: int) -> tuple[int, int]:
        """A new transition: the state after ``byte`` and the token that ends there, -1 if none does."""
        alive, ended = [], -1
        children, ends = self.children, self.ends
        for kind, node in self.subsets[number]:
            child = children[node].get(byte)
            if child is None:
                continue
            if children[child]:
                left = kind and self.narrow(kind, child)
                if left >= 0:
                    alive.append((left, child))
            token = ends[child]
            if token >= 0 and ended < 0 and (not kind or self.neighbours(kind, token)):
                ended = token
        if ended >= 0:
            alive.append((self.kind(ended), 0))
        if not alive:
            raise ValueError("the vocabulary lacks a byte")
        found = self.moves[number][byte] = (self.state(tuple(alive)), ended)
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.subsets) > MOST_STATES:
            self.reset()
        number, ended, moves = 0, [], self.moves
        for byte in piece:
            number, token = moves[number].get(byte) or self.move(number, byte)
            ended.append(token)
        out, at, tokens = [], len(piece), self.tokens
        while at:
            token = ended[at - 1]
            if token < 0:
                return list(self.merge(piece))
            out.append(token)
            at -= len(tokens[token])
        out.reverse()
        return out


class Pieces(dict):
    """Ids of pieces, each as little-endian unsigned 32-bit integers, made when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_PIECES:
            self.clear()
        found = self[piece] = array("I", self.encode(piece)).tobytes()
        return found


class Codec:
    """Texts to ids and back.

    ``special`` maps strings that are one token wherever they stand.  ``library`` leaves the
    merges inside a piece to the tiktoken library: for operators that only need ids.
    """

    def __init__(self, rank_file: str, pattern: str, special: tuple[tuple[str, int], ...] = (), library: bool = False):
        ranks = read_ranks(rank_file)
        if library:
            self.pieces = Pieces(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
        else:
            self.transducer = Transducer(ranks)
            self.pieces = Pieces(lambda piece: self.transducer.encode(piece.encode("utf-8", "replace")))
        self.vocabulary = [b""] * (max([*ranks.values(), *(i for _, i in special)]) + 1)
        for token, i in ranks.items():
            self.vocabulary[i] = token
        for token, i in special:
            self.vocabulary[i] = token.encode()
        self.special = dict(special)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if special else None
        self.pattern = regex.compile(pattern)
        self.short = pattern == PATTERN

    def ordinary(self, text: str) -> bytes:
        if self.short and not _OTHER.search(text):
            found = _SHORT.findall(text)
        else:
            found = self.pattern.findall(text)
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if self.split is None:
            return self.ordinary(text)
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special else self.ordinary(part) for part in self.split(text)
        )

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I")))


#: Fixed value: the pattern of the rank files' pre-tokenisation, as published with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str = PATTERN, special: tuple[tuple[str, int], ...] = (), library: bool = False) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(rank_file, pattern, special, library)


class Utf8Stream:
    """Incremental UTF-8: a state machine over bytes that hands out complete characters.

    The state is how many continuation bytes are still due, the range allowed
    for the next one and the bytes read so far; malformed bytes become U+FFFD,
    one per maximal ill-formed part, and never swallow the byte that follows.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def lead(self, byte: int) -> None:
        self.low, self.high = 0x80, 0xBF
        if 0xC2 <= byte <= 0xDF:
            self.due = 1
        elif 0xE0 <= byte <= 0xEF:
            self.due = 2
            self.low = 0xA0 if byte == 0xE0 else 0x80
            self.high = 0x9F if byte == 0xED else 0xBF
        elif 0xF0 <= byte <= 0xF4:
            self.due = 3
            self.low = 0x90 if byte == 0xF0 else 0x80
            self.high = 0x8F if byte == 0xF4 else 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        at = 0
        while at < len(data):
            if not self.due:
                # complete characters up to the last lead byte need no state
                end = len(data)
                while end > at and end > len(data) - 4 and data[end - 1] & 0xC0 == 0x80:
                    end -= 1
                end = end - 1 if end > at and data[end - 1] >= 0xC0 else len(data)
                if end > at:
                    out.append(data[at:end].decode("utf-8", "replace"))
                    at = end
                    continue
            byte = data[at]
            if self.due:
                if self.low <= byte <= self.high:
                    self.held.append(byte)
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    at += 1
                    if not self.due:
                        out.append(self.held.decode())
                        self.held.clear()
                else:
                    out.append("�")
                    self.held.clear()
                    self.due = 0
                continue
            self.lead(byte)
            at += 1
            if self.due:
                self.held.append(byte)
            else:
                out.append(bytes([byte]).decode("utf-8", "replace"))
        return "".join(out)

    def end(self) -> str:
        out = "�" if self.due else ""
        self.due = 0
        self.held.clear()
        return out


def decode_stream(codec: Codec, chunks: Iterable[bytes]) -> Iterator[str]:
    """Text of ids that arrive in chunks; a character split over tokens waits for its rest."""
    stream = Utf8Stream()
    for chunk in chunks:
        yield stream.feed(codec.decode(chunk))
    yield stream.end()


#: Ids handed to the decoder at a time.
CHUNK_BYTES = 4 * 65536

ENCODED = "ids binary, n_tokens long"


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [text or "" for text in batch.column(column).to_pylist()]


def encode(df: DataFrame, rank_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids (little-endian unsigned 32-bit) and n_tokens of each whole text.

    A null text counts as empty: no ids.  Rows are independent: one row out for each row in,
    repeated rows and null keys included; columns other than ``keep`` and ``text`` are not read.
    """
    schema = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file)
        for batch in batches:
            ids = [own.encode(x) for x in _texts(batch, "__text")]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "n_tokens"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{ddl(schema)}, {ENCODED}")


def decode(df: DataFrame, rank_file: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the text of each row's ids, decoded as a stream; null ids count as none."""
    schema = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file)
        for batch in batches:
            rows = [x or b"" for x in batch.column("__ids").to_pylist()]
            texts = ["".join(decode_stream(own, chunks(x))) for x in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, f"{ddl(schema)}, text string")


def round_trip(df: DataFrame, rank_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode, decode as a stream, and return digests of both: ``keep``, n_tokens, ids_sha256,
    decoded_sha256.  One pass, so neither ids nor bytes leave the task.  Null and repeated rows as
    in ``encode``."""
    schema = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file)
        for batch in batches:
            counts, firsts, seconds = [], [], []
            for x in batch.column("__text").to_pylist():
                ids, digest = own.encode(x or ""), hashlib.sha256()
                for piece in decode_stream(own, chunks(ids)):
                    digest.update(piece.encode())
                counts.append(len(ids) // 4)
                firsts.append(hashlib.sha256(ids).hexdigest())
                seconds.append(digest.hexdigest())
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(counts, pa.int64()), pa.array(firsts, pa.string()), pa.array(seconds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(
        run, f"{ddl(schema)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def chunks(ids: bytes) -> Iterator[bytes]:
    return (ids[i : i + CHUNK_BYTES] for i in range(0, len(ids), CHUNK_BYTES))
