"""The Merkle manifest against plain Python and SQL."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from preciario.llm import merkle, queries
from preciario.llm.shared import discard
from tests.comparing import connect, differences
from tests.llm.data import AWKWARD, documents


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def packed(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text) -> str:
    return sha("".join(map(packed, [*row[:4], text])))


def levels_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def runs_of(levels, i):
    for level in levels[:-1]:
        first = i // 3 * 3
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 3])
        i //= 3


def expected(rows):
    """rows: doc_id, source, lang, n_chars, text; line breaks go where the CRC-32 of doc_id is even."""
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row, leaf_of(row, row[4])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: levels_of([leaf for _, leaf in own]) for s, own in groups.items()}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (row, leaf) in enumerate(groups[s]):
            runs = [*runs_of(trees[s], i), *runs_of(top, j)]
            at = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                at = leaf_of(row, row[4].replace("\n", ""))
            for left, right in runs:
                at = sha(left + at + right)
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], "".join(a + b for a, b in runs), at, at == top[-1][0]))
    return out


def found(df):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return [tuple(r) for r in merkle.checked(df, altered).collect()]


CASES = {
    "none": [],
    "one": [(1, "a", "en", 2, "x\n")],
    "small groups": [(i, f"s{i % 5}" if i % 7 else None, "en", i, f"a\nb{i}") for i in range(40)],
    # over two rounds of tiles, a third of the rows and more in one source, repeats, null keys and null texts
    "hot source": [(i, "hot" if i % 3 else f"s{i % 40}", None if i % 4 else "x", i, None if i % 9 == 0 else f"t\n{i}") for i in range(4000)]
    + [(None, "hot", None, None, "q")] * 2
    + [(5, "hot", None, None, "zz\n")] * 3,
    "many sources": [(i, f"{i}", "en", 1, "\n") for i in range(1000)],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_plain_trees(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(found(df), key=repr) == sorted(expected(rows), key=repr)


def test_awkward_rows_and_clashing_columns(spark):
    df = documents(spark, AWKWARD).withColumns({c: F.lit("clash") for c in ("tree", "block", "idx", "key", "hash", "node", "root", "leaf", "at", "n")})
    rows = [(i, s, la, len(t) if t else None, t) for i, t, la, s in AWKWARD]
    assert sorted(found(df), key=repr) == sorted(expected(rows), key=repr)


def test_altered_rows_alone_fail(spark):
    df = spark.createDataFrame([(i, "a", "en", 1, f"text {i}") for i in range(30)], "doc_id long, source string, lang string, n_chars long, text string")
    altered = F.when(F.col("doc_id") == 7, "another").otherwise(F.col("text"))
    assert [r.doc_id for r in merkle.checked(df, altered).where(~F.col("verified")).collect()] == [7]


def test_nodes_are_linked_and_the_row_limit_is_put_back(spark):
    df = spark.createDataFrame([(i, "a", "en", 1, "x") for i in range(2000)], "doc_id long, source string, lang string, n_chars long, text string")
    before = spark.conf.get(merkle.ROW_LIMIT)
    manifest = merkle.build(df)
    ends = manifest.nodes.alias("n").join(manifest.nodes.alias("p"), F.expr("n.tree = p.tree AND n.block = p.block AND n.parent = p.node"), "left_anti")
    assert ends.count() == manifest.leaves.select("tree", "block").distinct().count()  # one last node above each tile
    assert manifest.nodes.groupBy("tree", "block", "node").count().where("count > 1").isEmpty()
    assert merkle.verify(manifest).where("verified").count() == 2000
    assert spark.conf.get(merkle.ROW_LIMIT) == before
    discard(manifest.leaves, manifest.nodes)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_op13_equals_oracle(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert differences(queries.QUERIES["op13_merkle"](spark, sf), connect(sf), queries.ORACLES["op13_merkle"]) == []
