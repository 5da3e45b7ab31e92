"""Prefix trie of conversations by double arrays, one per shard of neighbouring prefixes.

1. A turn is a 128-bit hash of role and text and a number of words; a conversation is the array of its turns.
2. Equal conversations become one sequence with a count, the smallest id and a digest of all ids.  The ids of a sequence are
   joined in chunks of a fixed id range first, then its chunks are hashed as a stream: a sequence that a third of all
   conversations share is a few thousand ids to a row, and never in memory as a whole.
3. Sequences are dealt by ranges of their order, so a shard holds whole neighbouring prefixes however many conversations
   begin alike.  A shard numbers its turns densely, packs BASE and CHECK arrays (``DoubleArray``), and walks its
   sequences through them; counts add up at the states.
4. Only prefixes of a shard's first or last sequence can go on in another shard.  Their partial aggregates are merged
   by prefix hash; sums over what lies below them are passed up by doubling jumps, so depth costs a logarithm of rounds.

A shard holds whole sequences, so a task needs room for the longest conversation (24 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.llm.jaccard_join import mixed
from preciario.llm.shared import discard, written

#: Ids joined in one row before they are hashed.
CHUNK = 4096
#: Slots looked at for a state's children before they go behind all others.
TRIES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()

_B, _C = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def conversations_of(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key and turns (array of a, b: hash of role and text; w: words) of each conversation.

    Turns are ordered by ``turn``, null first, those of the same number by their hashes; repeated rows are turns of
    their own.  A null role or text is empty.  Rows without a key take no part; other columns are not read.
    """
    said = [F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))]
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key), F.col(turn).alias("t"), F.xxhash64(F.lit(1), *said).alias("a"), F.xxhash64(F.lit(2), *said).alias("b"), F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("w")
    )
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "a", "b", "w"))).alias("turns"))
    return found.select(key, F.transform("turns", lambda x: F.struct(x.a.alias("a"), x.b.alias("b"), x.w.alias("w"))).alias("turns"))


def with_heads(conversations: DataFrame, base: Column, n: Column, most: int, key: str = "conv_id") -> DataFrame:
    """Every conversation with its first ``n`` (at most ``most``) turns replaced by those of conversation ``base``.

    All of them if ``base`` has fewer, none if there is no such conversation.
    """
    heads = conversations.select(F.col(key).alias("__base"), F.slice("turns", 1, most).alias("__head"))
    rows = conversations.withColumns({"__b": base, "__n": n.cast("int")})
    rows = rows.join(heads, F.col("__b") == F.col("__base"), "left")
    head = F.coalesce(F.slice("__head", F.lit(1), F.col("__n")), F.slice("turns", F.lit(1), F.lit(0)))
    return rows.select(key, F.concat(head, F.slice("turns", F.col("__n") + 1, F.size("turns"))).alias("turns"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, number and smallest id of each sequence; its chunks come together and in order."""
    at, digest, n, low = None, None, 0, None
    for batch in batches:
        out = []
        for s1, s2, ids, m, first in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "ids", "m", "first")), strict=True):
            if at == (s1, s2):
                digest.update(b"," + ids.encode())
                n, low = n + m, min(low, first)
                continue
            if at is not None:
                out.append((n, low, digest.hexdigest()))
            at, digest, n, low = (s1, s2), hashlib.sha256(ids.encode()), m, first
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["n", "low", "ends"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([low]), pa.array([digest.hexdigest()])], ["n", "low", "ends"])


def sequences(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """low (smallest id), n, ends (digest of the ids in order, joined by commas) and turns of each distinct conversation."""
    rows = conversations.select(key, F.xxhash64(F.lit(1), "turns").alias("s1"), F.xxhash64(F.lit(2), "turns").alias("s2"))
    ids = rows.groupBy("s1", "s2", F.expr(f"`{key}` div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    ids = ids.select("s1", "s2", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.size("ids").cast("long").alias("m"), F.get("ids", F.lit(0)).alias("first"))
    found = ids.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "chunk").mapInArrow(_streamed, "n long, low long, ends string")
    return found.join(conversations.select(F.col(key).alias("low"), "turns"), "low")


class DoubleArray:
    """BASE and CHECK over dense symbols: the child of state s by symbol x is t = BASE[s] + x if CHECK[t] = s; state 0 is the root.

    Nodes with several children take the first fitting slots, those with most children first; all others, the
    great majority, fill what is left.
    """

    def __init__(self, parent: np.ndarray, symbol: np.ndarray):
        """``parent`` and ``symbol`` of each node but the root (number 0), children of a node together, by symbol."""
        nodes = len(parent) + 1
        count = np.bincount(parent, minlength=nodes)
        first = np.zeros(nodes, np.int64)
        first[parent[::-1]] = np.arange(nodes - 2, -1, -1) + 1  # the first child of each node
        self.slot = np.zeros(nodes, np.int64)
        free = np.ones(2 * nodes + int(symbol.max(initial=0)) + 2, bool)
        free[0] = False
        start, end = 1, 1  # no free slot before start, no used one from end on
        wide = np.flatnonzero(count > 1)
        for node in wide[np.argsort(-count[wide], kind="stable")].tolist():
            kids = slice(first[node], first[node] + count[node])
            offsets = symbol[kids.start - 1 : kids.stop - 1]
            offsets = offsets - offsets[0]
            reach = end + int(offsets[-1]) + 1
            if reach >= len(free):
                free = np.concatenate([free, np.ones(max(len(free), reach), bool)])
            start += int(free[start:].argmax())
            at = end
            for low in range(start, min(end, start + TRIES), 1024):
                candidates = low + np.flatnonzero(free[low : min(low + 1024, end)])
                fits = free[candidates[:, None] + offsets[None, : 64]].all(axis=1)
                fits[fits] = [bool(free[c + offsets].all()) for c in candidates[fits].tolist()] if len(offsets) > 64 else True
                if fits.any():
                    at = int(candidates[fits.argmax()])
                    break
            self.slot[kids] = at + offsets
            free[at + offsets] = False
            end = max(end, at + int(offsets[-1]) + 1)
        single = first[count == 1]
        room = np.flatnonzero(free)[: len(single)]
        if len(room) < len(single):
            room = np.concatenate([room, len(free) + np.arange(len(single) - len(room))])
        self.slot[single] = room
        size = int(self.slot.max()) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        inner = np.flatnonzero(count)
        self.base[self.slot[inner]] = self.slot[first[inner]] - symbol[first[inner] - 1]
        self.check[self.slot[1:]] = self.slot[parent]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        at = self.base[states] + symbols
        inside = (at >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == states), at, -1)


def dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs, from 0, in their order."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def plain_nodes(lengths: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and symbol of each distinct prefix, level by level."""
    width = int(ids.max(initial=0)) + 1
    parents, symbols, known = [], [], 1
    active, node = np.flatnonzero(lengths > 0), np.zeros(len(lengths), np.int64)
    depth = 0
    while len(active):
        distinct, inverse = np.unique(node[active] * width + ids[starts[active] + depth], return_inverse=True)
        parents.append(distinct // width)
        symbols.append(distinct % width)
        node[active] = known + inverse
        known += len(distinct)
        depth += 1
        active = active[lengths[active] > depth]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *parents]), np.concatenate([none, *symbols])


_FIELDS = (
    "shard long, shared boolean, h1 long, h2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
)


def shard_nodes(shard: int, low: np.ndarray, n: np.ndarray, ends: list[str], lengths: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """The nodes of one shard's trie; those that other shards may have as well are ``shared`` and count nothing below a shared child."""
    starts = np.cumsum(lengths) - lengths
    ids = dense(a, b)
    tries = DoubleArray(*plain_nodes(lengths, starts, ids))
    size = len(tries.check)
    convs, depth, words = (np.zeros(size, np.int64) for _ in range(3))
    lowest = np.full(size, np.iinfo(np.int64).max)
    hashes = np.zeros((2, size), np.uint64)
    end = np.full(size, -1, np.int64)
    shared = np.zeros(size, bool)
    shared[0] = True
    convs[0], lowest[0] = n.sum(), low.min()
    if not lengths.all():
        end[0] = lengths.argmin()
    state, active, at = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths > 0), 0
    while len(active):
        turn = starts[active] + at
        before, now = state[active], tries.step(state[active], ids[turn])
        if (now < 0).any():
            raise AssertionError("a sequence left the trie")
        hashes[0, now] = mixed(hashes[0, before] * _C + a[turn].view(np.uint64))
        hashes[1, now] = mixed(hashes[1, before] * _B + b[turn].view(np.uint64) + np.uint64(at))
        np.add.at(convs, now, n[active])
        np.minimum.at(lowest, now, low[active])
        depth[now], words[now], state[active] = at + 1, w[turn], now
        at += 1
        last = lengths[active] == at
        end[now[last]] = active[last]
        shared[now[(active == 0) | (active == len(lengths) - 1)]] = True
        active = active[~last]
    used = np.append(0, np.flatnonzero(tries.check >= 0))
    parent = tries.check
    inner = used[1:]
    # what is below a shared child is left to the merge
    whole = inner[~shared[inner]]
    children = np.bincount(parent[whole], minlength=size)
    leaves = np.where((children == 0) & ~shared, 1, 0)
    saved = np.where(shared, 0, (convs - 1) * words)
    by_depth = whole[np.argsort(-depth[whole], kind="stable")]
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    up = np.where(used == 0, 0, parent[used])
    top, apart = used == 0, shared[used] & ~shared[up]
    if apart.any():
        raise AssertionError("a shared node below one that is not")
    signed = hashes.view(np.int64)
    no_parent = pa.array(top)
    columns = {
        "shard": np.full(len(used), shard),
        "shared": shared[used],
        "h1": signed[0, used],
        "h2": signed[1, used],
        "p1": pa.array(signed[0, up], mask=top),
        "p2": pa.array(signed[1, up], mask=top),
        "conv_id": lowest[used],
        "depth": depth[used],
        "parent_conv_id": pa.array(lowest[up], mask=shared[up] | np.asarray(no_parent)),
        "n_convs": convs[used],
        "n_children": children[used],
        "n_leaves": leaves[used],
        "saved_tokens": saved[used],
        "words": words[used],
        "ends": pa.array([ends[i] if i >= 0 else None for i in end[used].tolist()], pa.string()),
    }
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = [batch for batch in batches if batch.num_rows]
    if not whole:
        return
    rows = pa.Table.from_batches(whole).combine_chunks()
    turns = rows.column("turns").chunk(0)
    lengths = np.asarray(turns.value_lengths()).astype(np.int64)
    said = turns.flatten()
    out = shard_nodes(
        TaskContext.get().partitionId(),
        rows.column("low").to_numpy(),
        rows.column("n").to_numpy(),
        rows.column("ends").to_pylist(),
        lengths,
        *(np.asarray(said.field(c)).astype(np.int64) for c in ("a", "b", "w")),
    )
    for at in range(0, out.num_rows, 1 << 16):
        yield out.slice(at, 1 << 16)


def _passed_up(nodes: DataFrame) -> DataFrame:
    """h1, h2 and the sums of n_leaves and saved_tokens over each node and all below it; p1, p2 are null at the root."""
    jumps = written(nodes.select("h1", "h2", F.col("p1").alias("j1"), F.col("p2").alias("j2"), "n_leaves", "saved_tokens"), "trie-jumps")
    while not jumps.where(F.col("j1").isNotNull()).isEmpty():
        below = jumps.where(F.col("j1").isNotNull()).groupBy(F.col("j1").alias("h1"), F.col("j2").alias("h2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        on = jumps.select(F.col("h1").alias("j1"), F.col("h2").alias("j2"), F.col("j1").alias("k1"), F.col("j2").alias("k2"))
        moved = jumps.join(below, ["h1", "h2"], "left").join(on, ["j1", "j2"], "left")
        after = moved.select(
            "h1", "h2", F.col("k1").alias("j1"), F.col("k2").alias("j2"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")
        )
        after = written(after, "trie-jumps")
        discard(jumps)
        jumps = after
    return jumps.select("h1", "h2", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per distinct prefix of the conversations' turns, from the root (depth 0), which stands for no turn.

    conv_id: smallest member; depth; parent_conv_id: smallest member of the parent (null for the root); n_convs: members;
    n_children; n_leaves: nodes without children in the subtree, itself included; saved_tokens: over the subtree, (members - 1) *
    words of the last turn; ends_sha256: digest of the ids that end here.  ``conversations`` are those of ``conversations_of``;
    one without turns ends at the root.  Without conversations there is no node.
    """
    own = written(sequences(conversations, key), "trie-sequences")
    ordered = own.repartitionByRange("turns").sortWithinPartitions("turns")
    parts = written(ordered.select("low", "n", "ends", "turns").mapInArrow(_shards, _FIELDS), "trie-parts")
    discard(own)
    shared = parts.where("shared")
    merged = shared.groupBy("h1", "h2").agg(
        *[F.max(c).alias(c) for c in ("p1", "p2", "depth", "words", "ends")],
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    merged = written(merged, "trie-merged")
    kids = merged.where(F.col("p1").isNotNull()).groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("kids"))
    full = merged.join(kids, ["h1", "h2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    full = full.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
    sums = _passed_up(full)
    parents = merged.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    upper = full.drop("n_leaves", "saved_tokens").join(sums, ["h1", "h2"]).join(parents, ["p1", "p2"], "left")
    # a shard's nodes below a shared one learn its smallest member by shard, so no parent is a hot key
    known = shared.select("shard", "h1", "h2").join(merged.select("h1", "h2", F.col("conv_id").alias("__up")), ["h1", "h2"])
    known = known.select("shard", F.col("h1").alias("p1"), F.col("h2").alias("p2"), "__up")
    lower = parts.where(~F.col("shared") & F.col("parent_conv_id").isNull()).drop("parent_conv_id").join(known, ["shard", "p1", "p2"]).withColumnRenamed("__up", "parent_conv_id")
    rest = parts.where(~F.col("shared") & F.col("parent_conv_id").isNotNull())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256")]
    return upper.select(columns).unionByName(lower.select(columns)).unionByName(rest.select(columns))
