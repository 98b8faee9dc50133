"""Traversal, closure, blast radius, components and ranking over call edges.

Graphs whose edges are measured to be small are walked in memory, from many starts at once; larger ones in DataFrame
iterations, with equal results. Iterations write every round to shared storage, so neither lineage nor plans grow and a
lost executor costs a round at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callatlas.operators import held as bounds
from callatlas.operators.held import Digraph, held, measured, walk_blocks, walkable
from callatlas.sources.scratch import materialize, release
from callatlas.sources.tables import GraphTables, call_edges

DIRECTIONS = ("callees", "callers", "both")
#: Weights of blast radius, complexity and coupling in the combined ranking.
WEIGHTS = (0.4, 0.35, 0.25)
#: Rounds in which a closure grows by one edge before path lengths double.
STEPS = 16
#: Distances, one less than a power of two, whose pairs leave a walk together, and pairs of a batch at most.
LEVELS = 31
BATCH_PAIRS = 1 << 18
#: Edges of a neighbourhood that order-dependent walks take to the driver at most.
DRIVER_EDGES = 200_000


def directed(calls: DataFrame, direction: str) -> DataFrame:
    """Edges src, dst to follow in a direction."""
    return _steps(calls, direction).distinct()


def _steps(calls: DataFrame, direction: str) -> DataFrame:
    """directed(), but an edge comes as often as it is stored."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    down = calls.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    up = calls.select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"))
    return {"callees": down, "callers": up, "both": down.union(up)}[direction].where("src <> dst")


def bfs(calls: DataFrame, seeds: DataFrame, direction: str = "callees", max_depth: int | None = 3, known: DataFrame | None = None) -> DataFrame:
    """id and depth of everything reachable from `seeds` (column id); each node once, at its least depth. With
    `known`, nodes outside it are neither emitted nor expanded. Graphs and seeds of a measured small size are walked in
    memory, others a level at a time in DataFrames."""
    spark = calls.sparkSession
    # nodes are known or not a level at a time, and found ones made distinct: edges go through no shuffle of their own
    inside = lambda d: d if known is None else known.select("id").join(d, "id", "left_semi").distinct()
    edges = materialize(_steps(calls, direction), "edges")
    frontier = materialize(inside(seeds.select("id").distinct()), "seeds")
    small = measured(edges) <= bounds.HELD_BYTES
    if small and known is not None:
        edges = edges.join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    table = edges.toArrow() if small else None
    first = None if table is None else held(frontier)
    if first is not None:
        g, names = Digraph.of(table), first.column(0).to_pylist()
        depth = g.levels(g.numbers(names), max_depth)
        found = np.flatnonzero(depth >= 0)
        alone = sorted(set(names) - set(g.names[found].tolist()))  # seeds without edges
        ids, depths = [*g.names[found].tolist(), *alone], [*depth[found].tolist(), *[0] * len(alone)]
        return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.string()), "depth": pa.array(depths, pa.int32())}), "id string, depth int")
    levels = [frontier.withColumn("depth", F.lit(0))]
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        seen = reduce(DataFrame.union, [x.select("id") for x in levels])
        near = edges.join(frontier, edges["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = materialize(inside(near), "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        if len(levels) > 16:
            levels = [materialize(reduce(DataFrame.union, levels), "levels")]
    return reduce(DataFrame.union, levels)


def bfs_by_seed(calls: DataFrame, seeds: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """id, depth and seq of everything within max_depth of the seeds (columns id and seq, one row each): the first seed
    that reaches a node is the one with the least seq, and depth is the distance from it. Each round takes the least
    (seq, depth) over the neighbours', so no pair of seed and node is held."""
    spark = calls.sparkSession
    edges = materialize(directed(calls, direction), "edges")
    seeds = materialize(seeds.groupBy("id").agg(F.min("seq").cast("long").alias("seq")), "seeds")
    table = held(edges)
    names = None if table is None else held(seeds.select("id"))
    if names is not None:
        order = {r.id: r.seq for r in seeds.collect()}  # the ids were measured
        g = Digraph.of(table)
        ranked = sorted(order, key=order.get)
        inside = set(g.names.tolist())
        starts = [n for n in ranked if n in inside]
        at, depth = g.first_starts(g.numbers(starts), max_depth) if starts else (np.full(len(g.names), -1), np.full(len(g.names), -1))
        found = np.flatnonzero(at >= 0)
        alone = [n for n in ranked if n not in inside]
        ids = [*g.names[found].tolist(), *alone]
        seqs = [*[order[starts[k]] for k in at[found].tolist()], *[order[n] for n in alone]]
        rows = pa.table({"id": pa.array(ids, pa.string()), "depth": pa.array([*depth[found].tolist(), *[0] * len(alone)], pa.int32()), "seq": pa.array(seqs, pa.int64())})
        return spark.createDataFrame(rows, "id string, depth int, seq long")
    best = lambda d: d.groupBy("id").agg(F.min(F.struct("seq", "depth")).alias("b")).select("id", "b.depth", "b.seq")
    state = materialize(seeds.select("id", F.lit(0).alias("depth"), "seq"), "state")
    front = state
    for _ in range(max_depth):
        step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), (F.col("depth") + 1).alias("depth"), "seq")
        new = materialize(best(state.union(step)), "state")
        front = new.join(state, ["id", "depth", "seq"], "left_anti")
        state = new
        if front.isEmpty():
            break
    return state


def closure(edges: DataFrame) -> DataFrame:
    """src, dst, d of all connected ordered pairs over edges src, dst; d is the shortest path's length. A node on a
    cycle reaches itself. The result has as many rows as there are such pairs, up to the square of the nodes.

    A graph of a measured small size is broadcast and its nodes walk it in blocks, one task for each block, that many
    starts at a time. A larger one goes in DataFrames: pairs grow by one edge for STEPS rounds, so that a dense graph
    costs its pairs times the degree, then path lengths double, so that a deep one takes few rounds: a path longer
    than k begins with one of exactly k, so only pairs at that very distance are joined with all others."""
    edges = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    g = walkable(edges)
    if g is not None:
        return walk_blocks(edges.sparkSession, g, np.arange(len(g.names)), _pairs_of_block, "src string, dst string, d int")
    paths = front = materialize(edges.withColumn("d", F.lit(1)), "paths")
    reach = 1
    while not front.isEmpty():
        if reach < STEPS:
            grown = front.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
            front = materialize(grown.join(paths.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(reach + 1).alias("d")), "front")
            before, paths = paths, materialize(paths.union(front), "paths")
            reach += 1
        else:
            a, b = front.select("src", F.col("dst").alias("mid"), F.col("d").alias("d1")), paths.select(F.col("src").alias("mid"), "dst", F.col("d").alias("d2"))
            longer = a.join(b, "mid").select("src", "dst", (F.col("d1") + F.col("d2")).alias("d"))
            before, paths = paths, materialize(paths.union(longer).groupBy("src", "dst").agg(F.min("d").alias("d")), "paths")
            reach *= 2
            front = paths.where(F.col("d") == reach)
        release(before)
    return paths


def _pairs_of_block(g: Digraph, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of a block's starts, up to LEVELS distances at once, a target at a time. Distances are kept as binary
    digits in rows of bits, whose size does not depend on the number of pairs."""
    names = g.names.take(pa.array(starts))
    digits = np.zeros((LEVELS.bit_length(), len(g.names), -(-len(starts) // 64)), np.uint64)
    found: list[np.ndarray] = []
    base = 0
    for d, nodes, rows in g.spread(starts):
        if d - base > LEVELS:
            yield from _targets(g, names, digits, found, base)
            found, base = [], d - 1
        found.append(nodes)
        for k in range(len(digits)):
            if d - base >> k & 1:
                digits[k, nodes] |= rows
    yield from _targets(g, names, digits, found, base)


def _targets(g: Digraph, names: pa.Array, digits: np.ndarray, found: list[np.ndarray], base: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the starts `names` with the nodes in `found`, at `base` and what the digits say; these become zero.
    Targets reached by the most starts come first, and starts that reach the most of some targets: so files hold a
    target once and much the same run of starts again and again, which compresses well."""
    if not found:
        return
    nodes = np.unique(np.concatenate(found))
    reached = np.bitwise_count(np.bitwise_or.reduce([x[nodes] for x in digits])).sum(1, dtype=np.int64)
    spaced = _far(digits, nodes[:: -(-len(nodes) // 1024)], len(names))
    order = np.lexsort((spaced.sum(0, dtype=np.int64), -np.count_nonzero(spaced, axis=0)))
    names, nodes = names.take(pa.array(order)), nodes[np.argsort(-reached, kind="stable")]
    some = max(1, BATCH_PAIRS // len(names))
    for k in range(0, len(nodes), some):
        part = nodes[k : k + some]
        far = _far(digits, part, len(names)).take(order, axis=1)
        digits[:, part] = 0
        each = np.count_nonzero(far, axis=1)
        at = np.flatnonzero(far)
        src = (at - np.repeat(np.arange(len(part)) * len(names), each)).astype(np.int32)
        d = far.ravel()[at].astype(np.int32) + np.int32(base)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(src)), g.names.take(pa.array(np.repeat(part.astype(np.int32), each))), pa.array(d)], names=["src", "dst", "d"])


def _far(digits: np.ndarray, nodes: np.ndarray, n: int) -> np.ndarray:
    """The numbers whose binary digits the rows of bits of `nodes` are, one for each of n starts."""
    return np.bitwise_or.reduce([_bits(x[nodes], n) << np.uint8(k) for k, x in enumerate(digits)])


def _bits(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows of bits as rows of 0 and 1, one for each of n starts."""
    return np.unpackbits(rows.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :n]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and `root` of every node with an edge; nodes share a root if and only if they are connected.

    Each round every node turns to the neighbour (or itself) with the smallest hash, edges move to what their ends
    have turned to, and those within one node go. Hashes change from round to round, so no chain of ids is slow, and
    a constant share of nodes goes in each round. No node's neighbours are ever gathered.
    """
    edges = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges")
    labels = None
    step = 0
    while not edges.isEmpty():
        step += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("node"), rank("b").alias("o")).union(edges.select(F.col("b").alias("node"), rank("a").alias("o")))
        turned = materialize(both.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least("o", rank("node"))["to"].alias("to")), "turned")
        if labels is None:
            labels = turned.select("node", F.col("to").alias("root"))
        else:
            at = turned.select(F.col("node").alias("root"), "to")
            labels = materialize(labels.join(at, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        ends = edges.join(turned.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(turned.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = materialize(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def blast_depth(t: GraphTables, reach: DataFrame | None = None, g: Digraph | None = None) -> DataFrame:
    """id and blast_depth: the longest path from any entry point. Calls within a cycle count as one node (the depth
    would not be finite otherwise), so acyclic graphs get exact path lengths; nodes without callers 0.

    Beyond a measured small size it goes a level at a time: nodes at the end of a path of k calls from a root, for
    k = 0, 1, ...; cycles are found with `reach`, the closure. `g`: the graph, if it is held."""
    edges = None if g is not None else materialize(call_edges(t.method_calls, t.methods).select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")), "edges")
    g = walkable(edges) if g is None and reach is None else g
    if g is not None:
        far = materialize(t.spark.createDataFrame(pa.table({"id": g.names, "blast_depth": pa.array(g.longest(), pa.int32())}), "id string, blast_depth int"), "depths")
        return t.methods.select("id").join(far, "id", "left").select("id", F.coalesce("blast_depth", F.lit(0)).alias("blast_depth"))
    reach = closure(edges) if reach is None else reach
    back = reach.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    cyclic = materialize(reach.join(back, ["src", "dst"], "left_semi").groupBy("src").agg(F.min("dst").alias("scc")), "scc")
    dag = edges.join(cyclic.select("src", F.col("scc").alias("s")), "src", "left").join(cyclic.select(F.col("src").alias("dst"), F.col("scc").alias("e")), "dst", "left")
    dag = materialize(dag.select(F.coalesce("s", "src").alias("src"), F.coalesce("e", "dst").alias("dst")).where("src <> dst").distinct(), "dag")
    level = dag.select(F.col("src").alias("node")).distinct().join(dag.select(F.col("dst").alias("node")), "node", "left_anti")
    far = level.select("node", F.lit(0).alias("blast_depth"))
    depth = 0
    while True:
        depth += 1
        level = materialize(dag.join(level.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "level")
        if level.isEmpty():
            break
        far = materialize(far.union(level.select("node", F.lit(depth).alias("blast_depth"))).groupBy("node").agg(F.max("blast_depth").alias("blast_depth")), "depths")
    ids = t.methods.select("id").join(cyclic.select(F.col("src").alias("id"), "scc"), "id", "left").select("id", F.coalesce("scc", "id").alias("node"))
    return ids.join(far, "node", "left").select("id", F.coalesce("blast_depth", F.lit(0)).alias("blast_depth"))


def blast_radius(t: GraphTables, max_entry_points: int = 5) -> DataFrame:
    """id, direct and transitive callers (never itself), longest depth from an entry point and, nearest first, names of
    up to `max_entry_points` entry points of every method. Calls from or to unknown methods don't count.

    Of a graph of a measured size that tasks can hold no pair leaves one: a method walks to its callers, counts them and
    takes the nearest that nothing calls, and sends one row."""
    t = t.with_tables(methods=materialize(t.methods.select("id", "full_name"), "methods"))
    edges = materialize(call_edges(t.method_calls, t.methods).select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")), "edges")
    direct = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("direct_callers"))
    roots = t.methods.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select(F.col("id").alias("src"), "full_name")
    g, reach = walkable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), None
    if g is not None:

        def emit(g: Digraph, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield _reached(g, starts, max_entry_points)

        parts = materialize(walk_blocks(t.spark, g, np.arange(len(g.names)), emit, "dst string, n long, near array<struct<d:int,src:string>>"), "reached")
        above = parts.select(F.col("dst").alias("id"), F.col("n").alias("transitive_callers"))
        near = parts.select("dst", F.explode("near").alias("e")).select("dst", "e.d", "e.src")
        g = g.reversed()
    else:
        reach = closure(edges)
        above = reach.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("transitive_callers"))
        near = reach
    order = W.partitionBy("dst").orderBy("d", "src")  # Spark cuts each partition to the first ranks before shuffling
    named = near.join(roots, "src").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_entry_points)
    names = named.groupBy(F.col("dst").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "full_name"))), lambda s: s["full_name"]), ",").alias("entry_points"))
    out = t.methods.select("id").join(direct, "id", "left").join(above, "id", "left").join(blast_depth(t, reach, g), "id").join(names, "id", "left")
    return out.select("id", F.coalesce("direct_callers", F.lit(0)).alias("direct_callers"), F.coalesce("transitive_callers", F.lit(0)).alias("transitive_callers"), "blast_depth", F.coalesce("entry_points", F.lit("")).alias("entry_points"))


def _reached(back: Digraph, starts: np.ndarray, most: int) -> pa.RecordBatch:
    """Every start of a block, walking to callers: how many reach it (itself not counted), and of those that nothing
    calls the `most` nearest, by distance and then name."""
    n = np.zeros(len(starts), np.int64)
    entry = back.first[1:] == back.first[:-1]
    near: list[list[dict]] = [[] for _ in range(len(starts))]
    want = np.arange(len(starts))
    for d, nodes, rows in back.spread(starts):
        n += _counts(rows, len(starts))
        own = np.searchsorted(starts, nodes)
        own[own == len(starts)] = 0
        at = np.flatnonzero(starts[own] == nodes)
        n[own[at]] -= (rows[at, own[at] // 64] >> (own[at] % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        roots = np.flatnonzero(entry[nodes])
        roots = roots[np.argsort(nodes[roots])]
        for k in range(0, len(roots), 1024):
            if not len(want):
                break
            some = roots[k : k + 1024]
            bits = _bits(rows[some], len(starts))[:, want]
            room = most - np.array([len(near[w]) for w in want.tolist()])
            who, root = np.nonzero((bits & (np.cumsum(bits, axis=0, dtype=np.int32) <= room)).T)
            for w, name in zip(want[who].tolist(), back.names.take(pa.array(nodes[some[root]])).to_pylist()):
                near[w].append({"d": d, "src": name})
            want = np.array([w for w in want.tolist() if len(near[w]) < most], np.int64)
    kind = pa.list_(pa.struct([("d", pa.int32()), ("src", pa.string())]))
    return pa.RecordBatch.from_arrays([back.names.take(pa.array(starts)), pa.array(n), pa.array(near, kind)], names=["dst", "n", "near"])


def _counts(rows: np.ndarray, n: int) -> np.ndarray:
    """How many rows of bits have each of n bits set. Counts are added as numbers whose binary digits are rows of bits,
    half of them to the other half again and again."""
    total = np.zeros(n, np.int64)
    for k in range(0, len(rows), 8192):
        digits = [rows[k : k + 8192]]
        while len(digits[0]) > 1:
            if len(digits[0]) % 2:
                digits = [np.concatenate([x, np.zeros_like(x[:1])]) for x in digits]
            half, carry, out = len(digits[0]) // 2, None, []
            for x in digits:
                a, b = x[:half], x[half:]
                one = a ^ b
                out.append(one if carry is None else one ^ carry)
                carry = a & b if carry is None else (a & b) | (one & carry)
            digits = [*out, carry]
        for i, x in enumerate(digits):
            total += _bits(x, n)[0].astype(np.int64) << i if len(x) else 0
    return total


def blast_radius_of(calls: DataFrame, method_id: str) -> int:
    """Transitive callers of one method over all stored calls; counts itself if it is on a cycle."""
    first = directed(calls, "callers").where(F.col("src") == method_id).select(F.col("dst").alias("id")).distinct()
    return bfs(calls, first, "callers", None).count()


def callers_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and br, the number of nodes that reach each of `nodes` (column id) over edges src, dst; one on a cycle counts
    itself. Only these nodes are walked from, backwards; those that nothing reaches have no row."""
    back = materialize(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst").distinct(), "back")
    asked = materialize(nodes.select("id").distinct().join(back.select(F.col("src").alias("id")), "id", "left_semi"), "asked")
    g = walkable(back)
    if g is not None:
        names = asked.toArrow().column(0).combine_chunks()  # of the graph's size at most
        starts = pc.index_in(names, value_set=g.names).drop_null().to_numpy()

        def emit(g: Digraph, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(starts), np.int64)
            for _, _, rows in g.spread(starts):
                n += _counts(rows, len(starts))
            yield pa.RecordBatch.from_arrays([g.names.take(pa.array(starts)), pa.array(n)], names=["id", "br"])

        return walk_blocks(edges.sparkSession, g, np.unique(starts), emit, "id string, br long").where("br > 0")
    front = materialize(back.join(asked.withColumnRenamed("id", "src"), "src", "left_semi"), "front")
    seen = front
    while not front.isEmpty():
        grown = front.select("src", F.col("dst").alias("mid")).join(back.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        front = materialize(grown.join(seen, ["src", "dst"], "left_anti"), "front")
        seen = materialize(seen.union(front), "seen")
    return seen.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("br"))


def impact(t: GraphTables, method_id: str, max_depth: int | None = None) -> DataFrame:
    """The method and everything that calls it, with depth and whether nothing calls it in turn."""
    methods = materialize(t.methods.select("id", "full_name"), "methods")
    found = bfs(t.method_calls, methods.where(F.col("id") == method_id).select("id"), "callers", max_depth, methods)
    called = t.method_calls.select(F.col("callee_id").alias("id")).join(found.select("id"), "id", "left_semi").distinct().withColumn("called", F.lit(True))
    return found.join(methods, "id").join(called, "id", "left").select("id", "full_name", "depth", F.col("called").isNull().alias("is_entry"))


def impact_summary(found: DataFrame) -> DataFrame:
    """One row: affected methods (the target is one), entry points, greatest depth."""
    return found.agg(F.count("*").alias("affected"), F.count_if("is_entry").alias("entry_points"), F.max("depth").alias("max_depth"))


def callgraph(t: GraphTables, method_id: str, max_depth: int = 2, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) and edges as a bag: an edge once for each end it was scanned from, ends unknown or not."""
    seed = t.methods.where(F.col("id") == method_id).select("id")
    nodes = materialize(bfs(t.method_calls, seed, direction, max_depth, t.methods), "nodes")
    scanned = nodes.where(F.col("depth") < max_depth).select("id")
    parts = []
    if direction in ("callees", "both"):
        parts.append(t.method_calls.join(scanned.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").select("caller_id", "callee_id"))
    if direction in ("callers", "both"):
        parts.append(t.method_calls.join(scanned.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").select("caller_id", "callee_id"))
    return nodes, reduce(DataFrame.union, parts)


@dataclass(frozen=True)
class Traversal:
    """What a traversal is asked for; errors() lists what is wrong with it."""

    seed: str
    direction: str = "both"
    max_depth: int = 3
    order: str = "bfs"
    max_results: int | None = None

    def errors(self) -> list[str]:
        found = []
        if not self.seed or not self.seed.strip():
            found.append("seed: is needed")
        if self.direction not in DIRECTIONS:
            found.append(f"direction: one of {', '.join(DIRECTIONS)}")
        if self.max_depth < 1:
            found.append("max_depth: at least 1")
        if self.order not in ("bfs", "dfs"):
            found.append("order: bfs or dfs")
        if self.max_results is not None and self.max_results < 1:
            found.append("max_results: at least 1 if it is given")
        return found


@dataclass(frozen=True)
class Walked:
    """Nodes in the order of the walk with their depths, edges as they were scanned, and how many nodes were marked."""

    nodes: list[tuple[str, int]]
    edges: list[tuple[str, str, str]]
    total_visited: int


def check_weights(weights: tuple[float, float, float]) -> None:
    """An error unless the weights of a combined ranking sum to 1, give or take a hundredth."""
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError(f"ranking weights sum to {sum(weights):.2f} and not to 1")


def traverse(t: GraphTables, ask: Traversal) -> Walked:
    """Order-dependent walks: breadth first, or depth first with nodes marked when they are pushed; with `max_results`
    a walk stops once it has so many nodes, and the node that met the limit counts as visited. Neighbours go by id,
    callees before callers. Runs on the driver over the seed's depth-bounded neighbourhood, of DRIVER_EDGES at most;
    bfs() has no such bound."""
    if found := ask.errors():
        raise ValueError("; ".join(found))
    near = materialize(bfs(t.method_calls, t.methods.where(F.col("id") == ask.seed).select("id"), ask.direction, ask.max_depth).select("id"), "near")
    if near.isEmpty():
        return Walked([], [], 0)
    down_all = directed(t.method_calls, "callees")
    edges = down_all.join(near.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(down_all.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")).distinct()
    rows = edges.limit(DRIVER_EDGES + 1).collect()
    if len(rows) > DRIVER_EDGES:
        raise ValueError(f"over {DRIVER_EDGES} edges are near: use bfs() or a smaller depth")
    down: dict[str, list[str]] = {}
    up: dict[str, list[str]] = {}
    for s, d in sorted(map(tuple, rows)):
        down.setdefault(s, []).append(d)
        up.setdefault(d, []).append(s)
    sides = [(w, side) for w, side in (("callees", down), ("callers", up)) if ask.direction in (w, "both")]
    most = ask.max_results or math.inf
    seen, nodes, scanned = {ask.seed}, [(ask.seed, 0)], []
    todo = [(ask.seed, 0)]
    if ask.order == "dfs":
        nodes = []
    while todo and len(nodes) < most:
        node, depth = todo.pop(0 if ask.order == "bfs" else -1)
        if ask.order == "dfs":
            nodes.append((node, depth))
        if depth >= ask.max_depth:
            continue
        new = []
        for which, side in sides:
            for other in side.get(node, []):
                scanned.append((node, other, which) if which == "callees" else (other, node, which))
                if other in seen:
                    continue
                seen.add(other)
                if ask.order == "bfs":
                    if len(nodes) >= most:
                        break
                    nodes.append((other, depth + 1))
                new.append((other, depth + 1))
            if len(nodes) >= most:
                break
        todo += new if ask.order == "bfs" else reversed(new)
    return Walked(nodes, scanned, len(seen))


def walk(t: GraphTables, seed: str, direction: str = "callees", max_depth: int = 3, order: str = "bfs", max_results: int | None = None) -> list[tuple[str, int]]:
    """The nodes of traverse(), with their depths."""
    return traverse(t, Traversal(seed, direction, max_depth, order, max_results)).nodes


def scanned_edges(calls: DataFrame, nodes: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """from_id, to_id and direction of the edges that a walk scans: out of every node (id, depth) nearer than max_depth.
    With both directions an edge can come twice."""
    inner = nodes.where(F.col("depth") < max_depth).select("id")
    simple = calls.select("caller_id", "callee_id").where("caller_id <> callee_id").distinct()
    parts = []
    for which, end in (("callees", "caller_id"), ("callers", "callee_id")):
        if direction in (which, "both"):
            parts.append(simple.join(inner.withColumnRenamed("id", end), end, "left_semi").select(F.col("caller_id").alias("from_id"), F.col("callee_id").alias("to_id"), F.lit(which).alias("direction")))
    return reduce(DataFrame.union, parts)


def entry_callers(t: GraphTables, method_id: str) -> DataFrame:
    """Entry points that reach a method, nearest first: id, full_name and depth. All of them are found."""
    found = impact(t, method_id).where("is_entry and depth > 0")
    return found.select("id", "full_name", "depth").orderBy("depth", "id")


def rank(t: GraphTables, nodes: DataFrame, by: str = "combined", weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Score of nodes (column id): blast radius, complexity, coupling, or all three, each over its greatest among the
    nodes, weighted. A single node scores 0."""
    check_weights(weights)
    edges = materialize(t.method_calls.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).where("src <> dst").distinct(), "edges")
    nodes = materialize(nodes.select("id"), "ranked")
    br = callers_of(edges, nodes)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("coup"))
    cc = t.metrics.select(F.col("method_id").alias("id"), F.col("cognitive_complexity").alias("cc"))
    rows = nodes.select("id").join(br, "id", "left").join(ends, "id", "left").join(cc, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("br", "cc", "coup")])
    top = rows.agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"max_{c}") for c in ("br", "cc", "coup")], F.count("*").alias("n"))
    rows = rows.crossJoin(F.broadcast(top))  # one row
    part = {c: F.col(c) / F.col(f"max_{c}") for c in ("br", "cc", "coup")}
    score = {"blast": F.col("br").cast("double"), "complexity": F.col("cc").cast("double"), "coupling": F.col("coup").cast("double"), "combined": weights[0] * part["br"] + weights[1] * part["cc"] + weights[2] * part["coup"]}[by]
    return rows.select("id", F.when(F.col("n") > 1, F.round(score, 6)).otherwise(0.0).alias("score"))


def print_tree(edges: list[tuple[str, str]], root: str, max_depth: int = 5) -> str:
    """Indented call tree; a node seen before ends in (*)."""
    down: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        down.setdefault(a, []).append(b)
    lines, seen = [], set()

    def show(node: str, depth: int) -> None:
        again = node in seen
        lines.append("  " * depth + node + (" (*)" if again else ""))
        if not again and depth < max_depth:
            seen.add(node)
            for n in down.get(node, []):
                show(n, depth + 1)

    show(root, 0)
    return "\n".join(lines)
