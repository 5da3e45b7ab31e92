"""BPE, token counts and packing against the published libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies
from tokenizers import Tokenizer

from preciario.llm import bpe, packing, queries, token_counts
from tests.llm.data import AWKWARD, documents

SF = "/root/testdata/sf0.001"
PATHS = [queries.RANKS_MULTI, queries.RANKS_50K]


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def ids_of(encoded: bytes) -> list[int]:
    return np.frombuffer(encoded, np.uint32).tolist()


def test_pattern_is_the_published_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("path", PATHS)
def test_transducer_equals_merges(path):
    own, rng = bpe.codec(path), random.Random(3)
    transducer, core = own.transducer, library(path)._core_bpe
    for _ in range(3000):
        piece = bytes(rng.choice(b"ab \xc3\xa9th\n0zq") for _ in range(rng.randint(1, 40)))
        assert transducer.encode(piece) == list(core.encode_single_piece(piece)) == list(transducer.ranks.get(piece) is None and transducer.merge(piece) or transducer.encode(piece))
        piece = b"".join(transducer.tokens[rng.randrange(50000)] for _ in range(rng.randint(1, 5)))
        assert transducer.encode(piece) == list(core.encode_single_piece(piece))


def test_states_start_anew(monkeypatch):
    own = bpe.Transducer(bpe.read_ranks(PATHS[0]))
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 5)
    text = "unbelievable transformations notwithstanding " * 3
    assert [own.encode(w.encode()) for w in text.split()] == [library(PATHS[0]).encode_ordinary(w) for w in text.split()]
    assert len(own.subsets) < 200


def test_invented_words_share_states():
    """A state holds what may follow, not what came before: words no text has twice go through states that are there."""
    own, rng = bpe.Transducer(bpe.read_ranks(PATHS[0])), random.Random(5)
    core = library(PATHS[0])._core_bpe
    parts = sorted(t for t in own.ranks if 2 <= len(t) <= 4 and t.isalpha())[:400]
    words = [b" " + b"".join(rng.choice(parts) for _ in range(3)) for _ in range(5000)]
    assert [own.encode(w) for w in words] == [list(core.encode_single_piece(w)) for w in words]
    assert len(own.subsets) < 2 * len(words)


@settings(max_examples=200, deadline=None)
@given(strategies.text())
def test_any_text(text):
    own = bpe.codec(PATHS[0])
    encoded = own.encode(text)
    assert ids_of(encoded) == library(PATHS[0]).encode_ordinary(text)
    assert "".join(bpe.decode_stream(own, (encoded[i : i + 4] for i in range(0, len(encoded), 4)))) == text


@settings(max_examples=300, deadline=None)
@given(strategies.binary(), strategies.integers(1, 5))
def test_incremental_utf8(data, step):
    stream = bpe.Utf8Stream()
    assert "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step)) + stream.end() == data.decode("utf-8", "replace")


def test_round_trip(spark):
    docs, encode = documents(spark, AWKWARD), library(PATHS[0]).encode_ordinary
    got = sorted(map(tuple, bpe.round_trip(docs, PATHS[0]).collect()), key=repr)
    want = []
    for key, text, *_ in AWKWARD:
        ids = encode(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    texts = bpe.decode(bpe.encode(docs, PATHS[0]), PATHS[0])
    assert sorted(map(tuple, texts.collect()), key=repr) == sorted(((k, t or "") for k, t, *_ in AWKWARD), key=repr)
    assert bpe.round_trip(docs.limit(0), PATHS[0]).count() == 0


def test_op6_whole_table(spark):
    encode = library(queries.RANKS_MULTI).encode_ordinary
    rows = {r.doc_id: r for r in queries.QUERIES["op6_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = encode(doc.text)
        assert rows[doc.doc_id][1:] == (len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), hashlib.sha256(doc.text.encode()).hexdigest())


def test_section_counts(spark):
    """By decoding each token alone and placing its first byte."""
    docs, core = documents(spark, AWKWARD), library(PATHS[1])
    got = defaultdict(list)
    for r in token_counts.section_counts(docs, PATHS[1]).collect():
        got[r.doc_id].append(tuple(r)[1:])
    for key, text, *_ in AWKWARD:
        text = text or ""
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
        character = [i for i, c in enumerate(text) for _ in c.encode()]
        want, at = [[n, s, e, 0, 0] for n, (s, e) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True))], 0
        for i in core.encode_ordinary(text):
            size = len(core.decode_single_token_bytes(i))
            first, last = (max(n for n, s in enumerate(starts) if s <= character[b]) for b in (at, at + size - 1))
            want[first][3] += 1
            want[first][4] += last > first
            at += size
        copies = sum(k == key for k, *_ in AWKWARD)
        assert sorted(got[key]) == sorted(map(tuple, want * copies))
    assert token_counts.section_counts(docs.limit(0), PATHS[1]).count() == 0


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "abc def ghi", [0, 5]), (2, "abc", None)], "doc_id int, text string, cuts array<int>")
    got = sorted(map(tuple, token_counts.section_counts(docs, PATHS[1], starts="cuts").collect()))
    assert [r[1:4] for r in got] == [(0, 0, 5), (1, 5, 11), (0, 0, 3)]
    assert sum(r[4] for r in got[:2]) == len(library(PATHS[1]).encode_ordinary("abc def ghi")) and got[0][5] == 1


def packed_well(rows, texts):
    """Every id in exactly one piece, sequences gapless and full but for one of each window."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    copies, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        copies[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for key in {k for k, _ in texts}:
        own = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts if k == key]
        assert all(i == own[0] for i in own)
        data, covered = np.array(own[0], np.uint32), np.zeros(len(own[0]), int)
        for r in copies[key]:
            assert r.doc_tokens == len(data) and r.ids_crc32 == zlib.crc32(data[r.start : r.start + r.length].tobytes())
            covered[r.start : r.start + r.length] += 1
        assert (covered == len(own)).all()
    fill = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
        fill.append(at)
    return fill


def test_packing(spark):
    docs = documents(spark, AWKWARD).coalesce(1)
    rows = packing.pack(docs, queries.RANKS_50K, queries.SPECIAL_50K).collect()
    assert sum(f < 1024 for f in packed_well(rows, [(k, t) for k, t, *_ in AWKWARD])) <= 1
    assert packing.pack(docs.limit(0), queries.RANKS_50K).count() == 0


def test_op8_whole_table(spark):
    rows = queries.QUERIES["op8_packing"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fill = packed_well(rows, [(d.doc_id, d.text) for d in docs])
    assert sum(1024 - f for f in fill) <= 1024


def test_costs_are_balanced():
    lengths = np.random.default_rng(0).integers(1, 1024, 400)
    pieces = packing.assign(lengths)
    cost, used = defaultdict(float), defaultdict(int)
    for _, _, length, sequence, _ in pieces:
        cost[sequence] += packing.LINEAR * length + packing.QUADRATIC * length**2
        used[sequence] += length
    assert max(used.values()) == 1024 and sum(u < 1024 for u in used.values()) <= 1
    assert len(pieces) < 1.5 * len(lengths) and packing.assign(np.zeros(3, np.int64)) == []
