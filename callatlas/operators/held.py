"""Graphs small enough to be held by a task: numbered nodes, walks a level at a time, many starts as bits of words.

A graph is held by its names only if its edges' names take at most HELD_BYTES, which is measured first. One of up to
NUMBERED times that is numbered in Spark and held as numbers, 4 bytes an edge. Callers have another way, in DataFrames
and with equal results, for larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callatlas.sources.scratch import materialize

#: Bytes of names that a held table may have; larger ones stay distributed.
HELD_BYTES = 64 << 20
#: Graphs of up to so many times HELD_BYTES are held as numbers.
NUMBERED = 64
#: Starts that one walk of many starts takes at a time; their bits make rows of BLOCK / 8 bytes.
BLOCK = 1024
#: Bytes of a walk's bits for all nodes of a component: the larger it is, the fewer starts go at a time.
ROW_BYTES = 48 << 20


def measured(rows: DataFrame) -> int:
    """Bytes of the text of columns of strings, and an overhead per row."""
    size = sum((F.octet_length(F.col(c)) for c in rows.columns), F.lit(8 * len(rows.columns)))
    return rows.agg(F.sum(size)).first()[0] or 0


def held(rows: DataFrame, limit: int | None = None) -> pa.Table | None:
    """The rows, two columns of strings at most, if their text and an overhead per row fit `limit` bytes; else None."""
    return rows.toArrow() if measured(rows) <= (HELD_BYTES if limit is None else limit) else None


def walkable(edges: DataFrame) -> Digraph | None:
    """The graph of distinct edges src, dst, by components, if it is of a size that tasks can hold; else None."""
    size = measured(edges)
    if size <= HELD_BYTES:
        g = Digraph.of(edges.toArrow())
        return Digraph.by_components(pa.array(g.names, pa.string()), g.src, g.dst)
    if size > NUMBERED * HELD_BYTES:
        return None
    names = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().toArrow().column(0).combine_chunks()
    names = names.take(pc.sort_indices(names))
    numbers = materialize(edges.sparkSession.createDataFrame(pa.table({"id": names, "k": pa.array(np.arange(len(names), dtype=np.int32))}), "id string, k int"), "numbers")
    ends = lambda c: numbers.select(F.col("id").alias(c), F.col("k").alias(f"{c}_k"))
    table = edges.join(ends("src"), "src").join(ends("dst"), "dst").select("src_k", "dst_k").toArrow()
    return Digraph.by_components(names, table.column(0).to_numpy(), table.column(1).to_numpy())


@dataclass
class Digraph:
    """Nodes numbered in the order of their names, edges sorted by source. One made by_components() has its connected
    components one after another, from the numbers in `bounds` on, with nodes in the order of names in each."""

    names: np.ndarray | pa.Array
    first: np.ndarray
    dst: np.ndarray
    bounds: np.ndarray | None = None

    @staticmethod
    def of(table: pa.Table, names: np.ndarray | None = None) -> Digraph:
        """From two columns of names; with `names` (sorted) other nodes are left out."""
        ends = [np.array(table.column(k).to_pylist(), object) for k in (0, 1)]
        if names is None:
            names = np.array(sorted({*ends[0].tolist(), *ends[1].tolist()}), object)
        number = {n: k for k, n in enumerate(names.tolist())}
        pairs = np.array([[number.get(n, -1) for n in e.tolist()] for e in ends], np.int64).reshape(2, -1)
        pairs = np.unique(pairs[:, (pairs >= 0).all(0)], axis=1)
        return Digraph._sorted(names, pairs[0], pairs[1])

    @staticmethod
    def by_components(names: pa.Array, src: np.ndarray, dst: np.ndarray) -> Digraph:
        """From sorted names and the numbers of distinct edges' ends."""
        n = len(names)
        label = _connected(n, src, dst)
        order = np.argsort(label, kind="stable")
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        key = place[src].astype(np.int64) * n + place[dst]
        key.sort()
        first = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, n), minlength=n))])
        label = label[order]
        return Digraph(names.take(pa.array(order)), first, (key % max(1, n)).astype(np.int32), np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if n else np.zeros(0, np.int64))

    def part(self, lo: int, hi: int) -> Digraph:
        """The components that nodes lo to hi - 1 make up."""
        return Digraph(self.names.slice(lo, hi - lo), self.first[lo : hi + 1] - self.first[lo], self.dst[self.first[lo] : self.first[hi]] - lo)

    @staticmethod
    def _sorted(names: np.ndarray, src: np.ndarray, dst: np.ndarray) -> Digraph:
        order = np.lexsort((dst, src))
        return Digraph(names, np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(names)))]), dst[order])

    @property
    def src(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.names)), np.diff(self.first))

    def reversed(self) -> Digraph:
        return Digraph._sorted(self.names, self.dst, self.src)

    def numbers(self, names: list[str]) -> np.ndarray:
        at = np.searchsorted(self.names, np.array(names, object)) if len(self.names) else np.zeros(len(names), np.int64)
        ok = at < len(self.names)
        ok[ok] = self.names[at[ok]] == np.array(names, object)[ok]
        return at[ok]

    def edges_from(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each edge out of `nodes` the place of its source among them and its target."""
        sizes = self.first[nodes + 1] - self.first[nodes]
        place = np.repeat(np.arange(len(nodes)), sizes)
        at = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.first[nodes][place]
        return place, self.dst[at]

    def levels(self, starts: np.ndarray, max_depth: int | None = None) -> np.ndarray:
        """Least distance of each node from any of `starts`; -1 if it is further than max_depth or can't be reached."""
        depth = np.full(len(self.names), -1, np.int64)
        near, d = np.unique(starts), 0
        while len(near):
            depth[near] = d
            if max_depth is not None and d >= max_depth:
                break
            found = np.unique(self.edges_from(near)[1])
            near, d = found[depth[found] < 0], d + 1
        return depth

    def first_starts(self, starts: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node the place in `starts` of the first one that reaches it in max_depth steps, and its distance
        from that one; -1 for both where none does."""
        wide = max_depth + 1
        none = len(starts) * wide
        key = np.full(len(self.names), none, np.int64)
        np.minimum.at(key, starts, np.arange(len(starts)) * wide)
        near = np.unique(starts)
        for _ in range(max_depth):
            place, to = self.edges_from(near)
            before = key.copy()
            np.minimum.at(key, to, before[near][place] + 1)
            near = np.flatnonzero(key < before)
            if not len(near):
                break
        return np.where(key < none, key // wide, -1), np.where(key < none, key % wide, -1)

    def spread(self, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Walks from many starts at once: for each distance from 1 the nodes newly reached and, for each, a row of bits
        (little-endian bytes) of the starts that reach it. A start on a cycle reaches itself.

        Few nodes send their rows along their edges; where many do, all nodes fetch from those with edges to them, an
        edge of each at a time, so that no more than a row for each node is held."""
        width = -(-len(starts) // 64)
        seen = np.zeros((len(self.names), width), np.uint64)
        bits = np.zeros((len(self.names), width), np.uint64)
        k = np.arange(len(starts))
        np.bitwise_or.at(bits, (starts, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        near = np.unique(starts)
        rows, d = bits[near], 0
        while len(near):
            d += 1
            n = int((self.first[near + 1] - self.first[near]).sum())
            if not n:
                return
            if 8 * n >= len(self.dst):
                bits[:] = 0
                bits[near] = rows
                near, rows = self._fetched(bits)
                rows &= ~seen[near]
            else:
                place, to = self.edges_from(near)
                order = np.argsort(to, kind="stable")
                to = to[order]
                head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                near = to[head]
                rows = np.bitwise_or.reduceat(rows[place[order]], head, axis=0) & ~seen[near]
            new = rows.any(1)
            near, rows = near[new], rows[new]
            seen[near] |= rows
            if len(near):
                yield d, near, rows

    def _fetched(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes with edges to them, those with the most first, and the rows of all sources of their edges as one."""
        if getattr(self, "_into", None) is None:
            sizes = np.bincount(self.dst, minlength=len(self.names))
            nodes = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
            self._into = (nodes, (np.cumsum(sizes) - sizes)[nodes], -sizes[nodes], self.src[np.argsort(self.dst, kind="stable")].astype(np.int32))
        nodes, head, sizes, src = self._into
        out = bits[src[head]]
        for j in range(1, -int(sizes[0])):
            k = int(np.searchsorted(sizes, -j))  # nodes of more than j edges
            out[:k] |= bits[src[head[:k] + j]]
        return nodes, out

    def longest(self) -> np.ndarray:
        """Length of the longest path that ends in each node, all nodes of a cycle counted as one. Nodes go in the order
        in which nothing unvisited leads to them; a graph with cycles is walked over its components."""
        n = len(self.names)
        of = np.arange(n)
        core = self._cyclic()
        if len(core):
            of[core] = self._components(core)
        g = self
        if len(core):
            s, t = of[self.src], of[self.dst]
            pair = np.unique(s[s != t] * n + t[s != t])
            g = Digraph._sorted(self.names, pair // n, pair % n)
        open_, depth, d = np.bincount(g.dst, minlength=n), np.zeros(n, np.int64), 0
        near = np.flatnonzero(open_ == 0)
        while len(near):
            depth[near] = d
            to, times = np.unique(g.edges_from(near)[1], return_counts=True)
            open_[to] -= times
            near, d = to[open_[to] == 0], d + 1
        return depth[of]

    def _cyclic(self) -> np.ndarray:
        """What is left after nodes without an edge in, or without one out, are taken away again and again."""
        left = np.ones(len(self.names), bool)
        for g in (self, self.reversed()):
            open_ = np.bincount(g.dst[left[g.src] & left[g.dst]], minlength=len(left))
            near = np.flatnonzero((open_ == 0) & left)
            while len(near):
                left[near] = False
                to = g.edges_from(near)[1]
                to, times = np.unique(to[left[to]], return_counts=True)
                open_[to] -= times
                near = to[open_[to] == 0]
        return np.flatnonzero(left)

    def _components(self, core: np.ndarray) -> np.ndarray:
        """The least node of the strongly connected component of each node of `core`, by one depth-first walk with a
        stack of open nodes; only edges inside `core` count."""
        inside = np.zeros(len(self.names), bool)
        inside[core] = True
        index: dict[int, int] = {}
        low: dict[int, int] = {}
        root: dict[int, int] = {}
        open_: list[int] = []
        for start in core.tolist():
            if start in index:
                continue
            todo = [(start, iter(()))]
            while todo:
                v, rest = todo[-1]
                if v not in index:
                    index[v] = low[v] = len(index)
                    open_.append(v)
                    out = self.dst[self.first[v] : self.first[v + 1]]
                    rest = iter(out[inside[out]].tolist())
                    todo[-1] = (v, rest)
                for w in rest:
                    if w not in index:
                        todo.append((w, iter(())))
                        break
                    if w not in root:
                        low[v] = min(low[v], index[w])
                else:
                    todo.pop()
                    if todo:
                        low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                    if low[v] == index[v]:
                        members: list[int] = []
                        while not members or members[-1] != v:
                            members.append(open_.pop())
                        root |= dict.fromkeys(members, min(members))
        return np.array([root[v] for v in core.tolist()], np.int64)


def _connected(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least node of each node's connected component: roots turn to the least root that they have an edge with."""
    label = np.arange(n)
    while True:
        a, b = label[src], label[dst]
        apart = a != b
        if not apart.any():
            return label
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def blocks_of(g: Digraph, starts: np.ndarray, tasks: int) -> list[tuple[int, int, np.ndarray]]:
    """Sorted starts in blocks of at most BLOCK, with the bounds lo, hi of the components that they are in: small
    components go together, and a large one takes as few starts at a time as ROW_BYTES hold bits for."""
    most = min(BLOCK, max(64, -(-len(starts) // max(1, tasks) // 64) * 64))
    ends = np.append(g.bounds[1:], len(g.names))
    out, lo = [], 0
    for at, hi in zip(g.bounds.tolist(), ends.tolist()):
        if hi - lo < BLOCK and hi < len(g.names):
            continue
        for a, b in ((lo, at), (at, hi)) if hi - at >= BLOCK else ((lo, hi),):
            mine = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)]
            size = min(most, max(64, ROW_BYTES // (8 * max(1, b - a)) * 64))
            out += [(a, b, mine[k : k + size]) for k in range(0, len(mine), size)]
        lo = hi
    return out


def walk_blocks(spark: SparkSession, g: Digraph, starts: np.ndarray, emit, schema: str) -> DataFrame:
    """emit(graph, starts of a block) -> record batches, for each block its components alone as the graph; the whole is
    broadcast once. Blocks that follow each other share a task and what it knows of their components."""
    tasks = spark.sparkContext.defaultParallelism
    parts = blocks_of(g, starts, tasks)
    shared = spark.sparkContext.broadcast((g, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, blocks = shared.value
        of, part = None, None
        for b in batches:
            for k in b.column(0).to_pylist():
                lo, hi, mine = blocks[k]
                if of != (lo, hi):
                    of, part = (lo, hi), graph.part(lo, hi)
                yield from emit(part, mine - lo)

    return spark.range(0, len(parts), 1, max(1, min(len(parts), 16 * tasks))).mapInArrow(run, schema)
