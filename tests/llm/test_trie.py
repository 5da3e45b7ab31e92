"""The prefix trie against dictionaries and SQL."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies
from pyspark.sql import functions as F

from preciario.llm import queries, trie
from tests.comparing import connect, differences

SCHEMA = "conv_id long, turn long, role string, text string, words string, low int, n int, ends string, shard int, depth int"


def table(spark, rows):
    """rows: conv_id, turn, role, text; the other columns only clash with names used inside."""
    return spark.createDataFrame([(*r, "w", 1, 2, "e", 3, 4) for r in rows], SCHEMA)


def conversations(rows):
    """Turns (role, text) by conversation; turn numbers must not repeat."""
    out: dict = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def expected(said):
    """Node rows of conversations by id, each a list of (role, text)."""
    members: dict = {}
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    below = {path: [int(path not in children), (len(ids) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0] for path, ids in members.items()}
    for path in sorted(members, key=len, reverse=True):
        if path:
            for i in range(2):
                below[path[:-1]][i] += below[path][i]
    for path, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(said[c]) == len(path))))
        yield min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children.get(path, ())), *below[path], hashlib.sha256(ends.encode()).hexdigest()


def same(found, said):
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected(said), key=repr)


def random_rows(seed, n, longest=9):
    rng = random.Random(seed)
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            yield c * 3, t, rng.choice(["user", "bot", None]), rng.choice([None, "", "a  b\tc", "x", "naïve\x0bcafé"]) if rng.random() < 0.9 else f"own {c}"


HOT = [(c, t, "user", f"turn {t} of all") for c in range(9000) for t in range(3)] + [(20000 + c, t, "user", f"turn {min(t, 1)} of all" if t < 2 else f"{c}") for c in range(3000) for t in range(3)]
CASES = {
    "none": [],
    "one": [(5, None, None, None)],
    "no key": [(None, 1, "user", "x"), (-7, 3, "bot", "a b"), (-7, None, "bot", "first"), (2**62, 0, "bot", "first")],
    "random": list(random_rows(1, 700)),
    "copies and a hot beginning": HOT,
    "long": [(c, t, "user", f"{t if t != 1500 else c}") for c in range(6) for t in range(3000)],
    "repeated rows": [(1, 0, "a", "x"), (1, 1, "a", "x"), (2, 0, "a", "x"), (3, 4, "a", "x"), (3, 5, "a", "x"), (3, 6, "a", "x")],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_dictionaries(spark, case):
    same(trie.prefix_trie(trie.conversations_of(table(spark, CASES[case]))), conversations(CASES[case]))


def test_any_number_of_shards(spark):
    """Shards of a sequence or two: nearly all nodes are shared."""
    rows = list(random_rows(2, 300))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        same(trie.prefix_trie(trie.conversations_of(table(spark, rows))), conversations(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_turns_of_one_number_have_one_order(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "b", "y"), (1, 0, "a", "x"), (2, 0, "b", "y"), (2, 0, "a", "x"), (2, 0, "a", "x")]
    found = trie.conversations_of(table(spark, rows)).collect()
    assert len(found) == 2 and found[0].turns == found[1].turns and len(found[0].turns) == 3


def test_heads_of_other_conversations(spark):
    rows = [(0, t, "u", f"z{t}") for t in range(2)] + [(1, t, "u", f"o{t}") for t in range(5)] + [(41, t, "u", f"n{t}") for t in range(2)]
    own = trie.conversations_of(table(spark, rows))
    for n, want in ((0, {0: 2, 1: 5, 41: 2}), (2, {0: 2, 1: 5, 41: 0}), (3, {0: 2, 1: 4, 41: 0})):
        got = trie.with_heads(own, F.col("conv_id") - F.col("conv_id") % 20, F.lit(n), 3).collect()
        assert {r.conv_id: len(r.turns) for r in got} == want


@settings(max_examples=60, deadline=None)
@given(strategies.lists(strategies.lists(strategies.integers(0, 40), max_size=6), min_size=1, max_size=60))
def test_double_array_finds_exactly_its_words(words):
    lengths = np.array([len(w) for w in words])
    ids = np.array([x for w in words for x in w], np.int64)
    parent, symbol = trie.plain_nodes(lengths, np.cumsum(lengths) - lengths, ids)
    tries = trie.DoubleArray(parent, symbol)
    prefixes = {tuple(w[:d]) for w in words for d in range(len(w) + 1)}
    assert len(parent) + 1 == len(prefixes) == int((tries.check >= 0).sum()) + 1
    states = {(): 0}
    for path in sorted(prefixes, key=len):
        for x in range(41):
            to = int(tries.step(np.array([states[path]]), np.array([x]))[0])
            assert (to >= 0) == ((*path, x) in prefixes)
            if to >= 0:
                states[(*path, x)] = to
    assert len(set(states.values())) == len(states)


def test_double_array_of_many_children():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.arange(20000), rng.integers(0, 20000, 60000)])
    lengths = np.concatenate([np.ones(20000, np.int64), np.full(15000, 4)])
    parent, symbol = trie.plain_nodes(lengths, np.cumsum(lengths) - lengths, ids)
    tries = trie.DoubleArray(parent, symbol)
    assert (tries.check >= 0).sum() == len(parent) and len(tries.check) < 2 * len(parent) + 40000


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op12_equals_oracle(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert differences(queries.QUERIES["op12_trie"](spark, sf), connect(sf), queries.ORACLES["op12_trie"]) == []
