"""A hierarchical navigable small-world graph of one shard, as flat neighbour arrays.

Nodes are inserted in batches that double up to ``BATCH``: all nodes of a batch walk the
graph side by side (one array operation moves every walk), see each other as
candidates besides, choose diverse neighbours, and get edges back.  Level 0
keeps ``2 * LINKS`` neighbours of each node, higher levels ``LINKS``.
"""

from __future__ import annotations

import numpy as np

LINKS = 16
#: Beam width while building and while searching.
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
BATCH = 256
#: Nodes of each beam that are expanded in one step.
STEP = 4


def levels_of(n: int, seed: int = 1) -> np.ndarray:
    """Level of every node: geometric, by a generator of fixed seed."""
    u = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(1.0 - u) / np.log(LINKS)).astype(np.int64)


class Graph:
    """``levels`` per node, ``entry``, and per level an (n, width) array of neighbours, -1 for none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None):
        far = np.abs(vectors).max(initial=0.0) > 1e15
        self.x = vectors if far else vectors.astype(np.float32)
        self.levels = levels
        self.order = np.argsort(-levels, kind="stable")
        self.entry = int(self.order[0]) if len(levels) else -1
        top = int(levels.max(initial=0))
        self.links = links or [np.full((len(levels), 2 * LINKS if level == 0 else LINKS), -1, np.int32) for level in range(top + 1)]

    def distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of nodes."""
        off = self.x[nodes] - queries[:, None, :]
        return np.einsum("bkd,bkd->bk", off, off)

    def walk(self, queries: np.ndarray, starts: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at one level: (nodes, distances), nearest first, -1 and inf for none."""
        n, links = len(queries), self.links[level]
        lines = np.arange(n)[:, None]
        nodes = np.full((n, width), -1, np.int64)
        near = np.full((n, width), np.inf, self.x.dtype)
        opened = np.ones((n, width), bool)
        seen = np.zeros((n, len(self.x)), bool)
        nodes[:, 0], near[:, 0], opened[:, 0] = starts, self.distances(queries, starts[:, None])[:, 0], False
        seen[np.arange(n), starts] = True
        live = np.arange(n)
        step = min(STEP, width)
        while len(live):
            closed = np.where(opened[live], np.inf, near[live])
            best = np.argpartition(closed, step - 1, axis=1)[:, :step] if width > step else np.tile(np.arange(width), (len(live), 1))
            fresh = np.isfinite(np.take_along_axis(closed, best, 1)) | (~np.take_along_axis(opened[live], best, 1) & (nodes[live[:, None], best] >= 0))
            going = fresh.any(axis=1)
            live, best, fresh = live[going], best[going], fresh[going]
            if not len(live):
                break
            opened[live[:, None], best] = True
            found = links[np.where(fresh, nodes[live[:, None], best], 0)]
            found = np.where(fresh[:, :, None], found, -1).reshape(len(live), -1).astype(np.int64)
            found.sort(axis=1)
            valid = found >= 0
            valid[:, 1:] &= found[:, 1:] != found[:, :-1]
            valid &= ~seen[live[:, None], np.maximum(found, 0)]
            rows, columns = np.nonzero(valid)
            if not len(rows):
                continue
            hit = found[rows, columns]
            seen[live[rows], hit] = True
            off = self.x[hit] - queries[live[rows]]
            d = np.full(found.shape, np.inf, self.x.dtype)
            d[rows, columns] = np.einsum("kd,kd->k", off, off)
            every = np.concatenate([near[live], d], axis=1)
            take = np.argsort(every, axis=1, kind="stable")[:, :width]
            near[live] = np.take_along_axis(every, take, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(valid, found, -1)], axis=1), take, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros(found.shape, bool)], axis=1), take, 1) | (nodes[live] < 0)
        del lines
        return nodes, near

    def descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """Start nodes for ``level``: the nearest found on the levels above it."""
        at = np.full(len(queries), self.entry, np.int64)
        for above in range(len(self.links) - 1, level, -1):
            at = self.walk(queries, at, above, 1)[0][:, 0]
        return at

    def diverse(self, queries: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in order of distance, those nearer to the query than to any chosen before,
        then the nearest of the rest, up to ``most``."""
        n, width = nodes.shape
        there = nodes >= 0
        x = self.x[np.maximum(nodes, 0)]
        norm = np.einsum("bkd,bkd->bk", x, x)
        apart = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        chosen, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
        nearest = np.full((n, width), np.inf, self.x.dtype)
        for i in range(width):
            ok = there[:, i] & (near[:, i] < nearest[:, i]) & (count < most)
            chosen[:, i] = ok
            count += ok
            nearest = np.where(ok[:, None], np.minimum(nearest, apart[:, i]), nearest)
        rank = np.where(chosen, 0, np.where(there, width, 2 * width)) + np.arange(width)
        take = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((n, most), -1, np.int64)
        out[:, : take.shape[1]] = np.take_along_axis(nodes, take, 1)
        return out

    def insert(self, batch: np.ndarray) -> None:
        queries = self.x[batch]
        own = self.levels[batch]
        at = np.full(len(batch), self.entry, np.int64)
        for level in range(len(self.links) - 1, -1, -1):
            width = BUILD_WIDTH if (own >= level).any() else 1
            nodes, near = self.walk(queries, at, level, width)
            at = nodes[:, 0]
            who = np.flatnonzero(own >= level)
            if len(who):
                self.connect(batch[who], nodes[who], near[who], level)

    def connect(self, new: np.ndarray, nodes: np.ndarray, near: np.ndarray, level: int) -> None:
        most = self.links[level].shape[1]
        x = self.x[new]
        if len(new) > 1:  # nodes of one batch are candidates of each other
            peers = np.tile(new, (len(new), 1))
            d = self.distances(x, peers)
            np.fill_diagonal(d, np.inf)
            k = min(BUILD_WIDTH // 2, len(new) - 1)
            take = np.argpartition(d, k - 1, axis=1)[:, :k]
            nodes = np.concatenate([nodes, np.take_along_axis(peers, take, 1)], axis=1)
            near = np.concatenate([near, np.take_along_axis(d, take, 1)], axis=1)
            order = np.argsort(near, axis=1, kind="stable")[:, :BUILD_WIDTH]
            nodes, near = np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)
        chosen = self.diverse(x, nodes, near, LINKS)
        self.links[level][new, : chosen.shape[1]] = chosen
        rows, columns = np.nonzero(chosen >= 0)
        self.back(chosen[rows, columns], new[rows], level, most)

    def back(self, targets: np.ndarray, sources: np.ndarray, level: int, most: int) -> None:
        """Edges from ``targets`` to ``sources``; a full list is chosen anew."""
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        nodes, first, n = np.unique(targets, return_index=True, return_counts=True)
        width = int(n.max())
        added = np.full((len(nodes), width), -1, np.int64)
        place = np.arange(len(targets)) - np.repeat(first, n)
        added[np.repeat(np.arange(len(nodes)), n), place] = sources
        every = np.concatenate([self.links[level][nodes].astype(np.int64), added], axis=1)
        every.sort(axis=1)
        same = np.zeros(every.shape, bool)
        same[:, 1:] = every[:, 1:] == every[:, :-1]
        every[same] = -1
        d = np.where(every >= 0, self.distances(self.x[nodes], np.maximum(every, 0)), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        every, d = np.take_along_axis(every, order, 1), np.take_along_axis(d, order, 1)
        full = (every >= 0).sum(axis=1) > most
        self.links[level][nodes[~full]] = every[~full][:, :most] if every.shape[1] >= most else np.pad(every[~full], ((0, 0), (0, most - every.shape[1])), constant_values=-1)
        for part in np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) // BATCH))):
            if len(part):
                wide = every[part][:, : 2 * most]
                self.links[level][nodes[part]] = self.diverse(self.x[nodes[part]], wide, d[part][:, : 2 * most], most)

    def build(self) -> Graph:
        done = 1
        while done < len(self.order):
            size = min(done, BATCH, len(self.order) - done)
            self.insert(self.order[done : done + size])
            done += size
        return self

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """The nodes of each query's final beam, -1 for none."""
        if self.entry < 0:
            return np.full((len(queries), 0), -1, np.int64)
        queries = queries.astype(self.x.dtype)
        return self.walk(queries, self.descend(queries, 0), 0, width)[0]
