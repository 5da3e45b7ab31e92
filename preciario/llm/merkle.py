"""Merkle manifest of a dataset: one tree per source, one tree over their roots, proofs by a recursive query.

**Building.**  Leaves are numbered inside their source and dealt into tiles of ``TILE`` = 3 ** ``HEIGHT``; a tile builds
its levels with array functions and leaves one hash, and the hashes of all tiles are the leaves of the next round.  So
a source of any size takes ``log(rows) / log(TILE)`` shuffles, and no group is larger than a tile.  The roots of the
sources are built over in the same way.

**Node rows.**  The built levels are stored as parent-linked rows: a node knows the siblings in the runs of its
next ``STRIDE`` levels and its ancestor above them.  The rows of a tile are keyed by the tile, and what lies above a tile
is stored once per tile, so no key has more than ``TILE`` leaves below it, near the root as well.

**Climb.**  A recursive query starts at every (possibly altered) leaf, joins its node row, folds the hash with the
siblings on both sides, and goes on at the ancestor until none is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.functions.ordering import positions
from preciario.llm.shared import discard, written

#: Children of a node.
ARITY = 3
#: Levels of a tile, and those that one step of the climb ascends.
HEIGHT, STRIDE = 6, 3
TILE = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def packed(value: Column) -> Column:
    """A value as text that can't run into its neighbours: UTF-8 byte count, colon, value; a dash if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[packed(v) for v in values]), 256)


@dataclass
class Manifest:
    """``leaves``: one row per row of the dataset; ``nodes``: the levels, parent-linked; ``root``: null without rows."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def _run(level: str, at: str) -> str:
    """The siblings of node ``at`` of an array of hashes, to its left and right."""
    return (
        f"named_struct('left', unhex(array_join(slice({level}, int({at} div {ARITY}) * {ARITY} + 1, int({at} % {ARITY})), '')), "
        f"'right', unhex(array_join(slice({level}, int({at}) + 2, {ARITY - 1} - int({at} % {ARITY})), '')))"
    )


def _runs(first: int, at: str) -> str:
    """The runs of node ``at`` of level ``first`` and its ancestors below the next stride."""
    found = ", ".join(_run(f"l{first + j}", f"({at} div {ARITY**j})") for j in range(STRIDE))
    return f"slice(array({found}), 1, int(least(greatest(height - {first}, 0), {STRIDE})))"


def _tiles(items: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """tree, block, height, items and levels ``l0`` to ``l6`` of each tile.

    ``items`` are tree, n (nodes of the tree), at (from 0), hash and columns to be ``carried`` along.
    """
    height = sum((F.col("n") > ARITY**k).cast("int") for k in range(HEIGHT))
    out = (
        items.groupBy("tree", F.expr(f"at div {TILE}").alias("block"))
        .agg(F.max(height).alias("height"), F.array_sort(F.collect_list(F.struct(F.expr(f"int(at % {TILE})").alias("idx"), "hash", *carried))).alias("items"))
        .withColumn("l0", F.expr("transform(items, x -> x.hash)"))
    )
    for k in range(1, HEIGHT + 1):
        above = f"transform(sequence(0, int((size(l{k - 1}) - 1) div {ARITY})), i -> sha2(array_join(slice(l{k - 1}, {ARITY} * i + 1, {ARITY}), ''), 256))"
        out = out.withColumn(f"l{k}", F.expr(f"if(height >= {k}, {above}, l{k - 1})"))
    return out


def _built(items: DataFrame, most: int, carried: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The tiles of every round, written, and tree and hash of every root.  ``most`` is the largest n."""
    rounds = []
    while True:
        tiles = written(_tiles(items, carried if not rounds else ()), "merkle-tiles")
        rounds.append(tiles)
        tops = tiles.select("tree", F.col("block").alias("at"), F.expr(f"l{HEIGHT}[0]").alias("hash"))
        most = -(-most // TILE)
        if most <= 1:
            return rounds, tops.select("tree", "hash")
        sizes = tops.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
        items = tops.join(sizes, "tree")


def _above(rounds: list[DataFrame], start: DataFrame) -> DataFrame:
    """tree, block, path and ``start``'s other columns for the tiles of the first round.

    ``start`` holds tree and the path above its root; a path is an array of runs by strides.
    """
    carry = start.withColumn("block", F.lit(0).cast("long"))
    others = [c for c in start.columns if c not in ("tree", "path")]
    for tiles in reversed(rounds[1:]):
        own = f"filter(array({_runs(0, 'i')}, {_runs(STRIDE, f'(i div {ARITY**STRIDE})')}), x -> size(x) > 0)"
        items = tiles.select("tree", F.col("block").alias("up"), F.posexplode(F.expr(f"transform(sequence(0, size(l0) - 1), i -> {own})")).alias("i", "own"))
        upper = carry.select("tree", F.col("block").alias("up"), F.col("path").alias("upper"), *others)
        carry = items.join(upper, ["tree", "up"]).select("tree", (F.col("up") * TILE + F.col("i")).alias("block"), F.concat("own", "upper").alias("path"), *others)
    return carry


def build(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source") -> Manifest:
    """The manifest of ``docs``: a tree per ``group`` over its rows by ``key``, one over the groups.

    ``altered`` replaces the last of ``fields`` where a stored row was tampered with (null values stay null);
    it is hashed beside the original.  A null key comes first; rows of one key are ordered by their hashes, so repeated rows
    are leaves of their own with one defined result.  A null group is a group, and the first one.  Other columns are not read.
    """
    values = [F.col(f) for f in fields]
    leaf, changed = leaf_hash(values), leaf_hash([*values[:-1], altered if altered is not None else values[-1]])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(F.col(key).alias("key"), tree.alias("tree"), leaf.alias("hash"), F.when(changed != leaf, changed).alias("altered"))
    rows = written(rows.repartitionByRange("tree", F.asc_nulls_first("key"), "hash").withColumn("part", F.spark_partition_id()), "merkle-rows")
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    placed = positions(rows, ["tree"], [F.asc_nulls_first("key"), F.col("hash")], F.col("part"), "at").withColumn("at", F.col("at") - 1)
    # the height of a tile needs its tree's size, joined to tiles, not to rows
    blocks = sizes.select("tree", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {TILE})")).alias("block"))
    placed = placed.withColumn("block", F.expr(f"at div {TILE}")).join(blocks, ["tree", "block"])
    rounds, roots = _built(placed, most, ("key", "altered"))
    discard(rows)
    roots = written(roots.repartitionByRange("tree").withColumn("part", F.spark_partition_id()), "merkle-roots")
    top = positions(roots, [], ["tree"], F.col("part"), "at").withColumn("at", F.col("at") - 1)
    n_trees = roots.count()
    above, last = _built(top.select(F.lit("").alias("tree"), F.lit(n_trees).cast("long").alias("n"), "at", "hash", F.col("tree").alias("member")), n_trees, ("member",))
    found = last.first()
    own = f"filter(array({_runs(0, 'x.idx')}, {_runs(STRIDE, f'(x.idx div {ARITY**STRIDE})')}), y -> size(y) > 0)"
    upper = _above(above, last.select("tree", F.array().cast("array<array<struct<left:binary,right:binary>>>").alias("path"))).select("block", F.col("path").alias("upper"))
    member = above[0].select("block", F.inline(F.expr(f"transform(items, x -> named_struct('member', x.member, 'subroot', x.hash, 'own', {own}))")))
    start = member.join(upper, "block").select(F.col("member").alias("tree"), "subroot", F.concat("own", "upper").alias("path"))
    carry = written(_above(rounds, start), "merkle-paths")
    discard(roots, *above, *rounds[1:])
    tiles = rounds[0]
    width = f"int(ceil(height / {STRIDE}))"
    leaf_rows = f"transform(items, x -> named_struct('key', x.key, 'idx', x.idx, 'leaf', x.hash, 'altered', x.altered, 'runs', {_runs(0, 'x.idx')}))"
    leaves = tiles.join(carry.select("tree", "block", "subroot"), ["tree", "block"]).select("tree", "block", "subroot", "height", F.inline(F.expr(leaf_rows)))
    first = F.when(F.col("height") == 0, 0).otherwise(TILE + F.expr(f"if(height > {STRIDE}, int(idx div {ARITY**STRIDE}), 0)")).cast("long")
    leaves = written(leaves.select("tree", "block", "idx", F.col("key").alias(key), "leaf", "altered", "subroot", first.alias("parent"), "runs"), "merkle-leaves")
    inner = tiles.where(F.col("height") > STRIDE).select(
        "tree", "block", F.inline(F.expr(f"transform(l{STRIDE}, (x, i) -> named_struct('node', bigint({TILE} + i), 'parent', bigint({2 * TILE}), 'runs', {_runs(STRIDE, 'i')}))"))
    )
    outer = carry.join(tiles.select("tree", "block", F.expr(width).alias("width")), ["tree", "block"]).select(
        "tree", "block", F.inline(F.expr(f"transform(path, (x, i) -> named_struct('node', bigint((width + i) * {TILE}), 'parent', bigint((width + i + 1) * {TILE}), 'runs', x))"))
    )
    nodes = written(inner.unionByName(outer), "merkle-nodes")
    discard(tiles, carry)
    return Manifest(leaves, nodes, found.hash if found else None)


_FOLD = "aggregate({runs}, {hash}, (a, r) -> unhex(sha2(concat(lower(hex(r.left)), lower(hex(a)), lower(hex(r.right))), 256)))"
_SIBLINGS = "aggregate({runs}, X'', (a, r) -> concat(a, r.left, r.right))"
_CLIMB = f"""
WITH RECURSIVE climb(tree, block, idx, node, step, siblings, folded) AS (
  SELECT tree, block, idx, parent, 0, {_SIBLINGS.format(runs='runs')}, {_FOLD.format(runs='runs', hash='unhex(coalesce(altered, leaf))')} FROM {{leaves}}
  UNION ALL
  SELECT /*+ MERGE(n) */ c.tree, c.block, c.idx, n.parent, c.step + 1, {_SIBLINGS.format(runs='n.runs')}, {_FOLD.format(runs='n.runs', hash='c.folded')}
  FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.block = c.block AND n.node = c.node
)
SELECT * FROM climb"""

ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def verify(manifest: Manifest, key: str = "doc_id") -> DataFrame:
    """key, leaf, subroot, root, proof (the siblings from leaf to root, left to right, as one text), folded_root and verified.

    ``folded_root`` is climbed from the altered leaf where there is one.  The root has no row and ends the climb.
    """
    spark = manifest.leaves.sparkSession
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # every leaf climbs; the session's own limit is put back once the climb is written
    try:
        steps = spark.sql(_CLIMB, leaves=manifest.leaves, nodes=manifest.nodes)
        path = steps.groupBy("tree", "block", "idx").agg(F.array_sort(F.collect_list(F.struct("step", "siblings", "folded"))).alias("steps"))
        path = path.select("tree", "block", "idx", F.expr("lower(hex(aggregate(steps, X'', (a, x) -> concat(a, x.siblings))))").alias("proof"), F.expr("lower(hex(element_at(steps, -1).folded))").alias("folded_root"))
        root = F.lit(manifest.root).cast("string")
        out = manifest.leaves.join(path.hint("merge"), ["tree", "block", "idx"])
        out = out.select(key, "leaf", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))
        return written(out, "merkle-proofs")
    finally:
        spark.conf.set(ROW_LIMIT, before)


def checked(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """``verify`` of a manifest built for it alone."""
    manifest = build(docs, altered)
    out = verify(manifest)
    discard(manifest.leaves, manifest.nodes)
    return out
