"""Graphs held in memory and graphs in DataFrames give the same, and both equal plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from callatlas.operators import graph as G
from callatlas.operators import held
from callatlas.sources.tables import GraphTables

PAIRS = {
    "acyclic": sorted({(f"n{a:02d}", f"n{b:02d}") for rng in [random.Random(1)] for a, b in (sorted((rng.randrange(40), rng.randrange(40))) for _ in range(90)) if a != b}),
    "cyclic": sorted({(f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}") for rng in [random.Random(2)] for _ in range(45)}),
    "deep": [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(18)] + [("n004", "n009")],
    "loops": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("x", "b"), ("z", "z")],
}


def reach(pairs):
    down = {}
    for a, b in pairs:
        if a != b:
            down.setdefault(a, set()).add(b)
    out = {}
    for a in down:
        level, d, seen = {a}, 0, set()
        while level := {y for x in level for y in down.get(x, ())} - seen:
            d += 1
            seen |= level
            out |= {(a, b): d for b in level}
    return out


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_both_ways_agree(spark, monkeypatch, name):
    pairs = PAIRS[name]
    want = reach(pairs)
    ids = sorted({x for p in pairs for x in p})
    df = spark.createDataFrame(pairs, "caller_id string, callee_id string")
    t = GraphTables(spark).with_tables(methods=spark.createDataFrame([(i, f"f {i}", i) for i in ids], "id string, full_name string, name string"), method_calls=df)
    seen = []
    for bytes_ in (held.HELD_BYTES, -1):
        monkeypatch.setattr(held, "HELD_BYTES", bytes_)
        monkeypatch.setattr(G, "STEPS", 4)
        edges = G.directed(df, "callees")
        assert {(r.src, r.dst): r.d for r in G.closure(edges).collect()} == want
        counts = {r.id: r.br for r in G.callers_of(edges, t.methods.where("id > 'b'")).collect()}
        assert counts == {i: n for i in ids if i > "b" and (n := sum(b == i for _, b in want))}
        levels = {r.id: r.depth for r in G.bfs(df, spark.createDataFrame([(ids[0],), ("alone",)], "id string"), "callees", None).collect()}
        assert levels == {b: d for (a, b), d in want.items() if a == ids[0] and b != a} | {ids[0]: 0, "alone": 0}
        rows = {r.id: tuple(r)[1:] for r in G.blast_radius(t, 3).collect()}
        assert {i: r[1] for i, r in rows.items()} == {i: sum(b == i and a != i for a, b in want) for i in ids}
        called = {b for a, b in pairs if a != b}
        near = {i: sorted((d, a) for (a, b), d in want.items() if b == i and a not in called)[:3] for i in ids}
        assert {i: r[3] for i, r in rows.items()} == {i: ",".join(f"f {a}" for _, a in near[i]) for i in ids}
        seen.append(rows)
    assert seen[0] == seen[1]


def test_longest_path_counts_a_cycle_as_one(spark):
    table = spark.createDataFrame(PAIRS["loops"], "src string, dst string").where("src <> dst").toArrow()
    g = held.Digraph.of(table)
    assert dict(zip(g.names.tolist(), g.longest().tolist())) == {"a": 1, "b": 1, "x": 0, "c": 2, "d": 2, "e": 3}


def test_size_is_measured(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None)], "src string, dst string")
    assert held.held(df.where("dst is not null"), 18).num_rows == 1 and held.held(df.where("dst is not null"), 17) is None
    assert held.held(df.limit(0)).num_rows == 0


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_graphs_held_as_numbers_agree(spark, monkeypatch, name):
    pairs = PAIRS[name]
    want = reach(pairs)
    ids = sorted({x for p in pairs for x in p})
    df = spark.createDataFrame(pairs, "caller_id string, callee_id string")
    t = GraphTables(spark).with_tables(methods=spark.createDataFrame([(i, f"f {i}", i) for i in ids], "id string, full_name string, name string"), method_calls=df)
    monkeypatch.setattr(held, "HELD_BYTES", 1)
    monkeypatch.setattr(held, "NUMBERED", 1 << 20)
    monkeypatch.setattr(held, "BLOCK", 3)  # components are packed and cut
    monkeypatch.setattr(G, "STEPS", 0)  # the way in DataFrames would not end right
    edges = G.directed(df, "callees")
    assert {(r.src, r.dst): r.d for r in G.closure(edges).collect()} == want
    assert {r.id: r.br for r in G.callers_of(edges, t.methods).collect()} == {i: n for i in ids if (n := sum(b == i for _, b in want))}
    called = {b for a, b in pairs if a != b}
    rows = {r.id: tuple(r)[1:] for r in G.blast_radius(t, 3).collect()}
    assert {i: r[1] for i, r in rows.items()} == {i: sum(b == i and a != i for a, b in want) for i in ids}
    near = {i: sorted((d, a) for (a, b), d in want.items() if b == i and a not in called)[:3] for i in ids}
    assert {i: r[3] for i, r in rows.items()} == {i: ",".join(f"f {a}" for _, a in near[i]) for i in ids}


def test_wide_walks_count_as_plain_python(spark):
    rng = random.Random(5)
    pairs = sorted({(a, b) for a, b in (sorted((rng.randrange(300), rng.randrange(300))) for _ in range(3000)) if a != b} | {(301, 302), (302, 301)})
    edges = spark.createDataFrame([(f"{a:03d}", f"{b:03d}") for a, b in pairs], "src string, dst string")
    want = {}
    for _, b in reach(pairs):
        want[f"{b:03d}"] = want.get(f"{b:03d}", 0) + 1
    assert {r.id: r.br for r in G.callers_of(edges, edges.selectExpr("dst as id")).collect()} == want


def test_rank_walks_graphs_held_as_numbers(spark, monkeypatch):
    pairs = PAIRS["cyclic"]
    ids = sorted({x for p in pairs for x in p})
    t = GraphTables(spark).with_tables(metrics=spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "method_id string, cognitive_complexity int"), method_calls=spark.createDataFrame(pairs, "caller_id string, callee_id string"))
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    want = {tuple(r) for r in G.rank(t, nodes).collect()}
    walks = []
    monkeypatch.setattr(G, "walk_blocks", lambda *a, f=G.walk_blocks: walks.append(1) or f(*a))
    monkeypatch.setattr(held, "HELD_BYTES", 1)
    monkeypatch.setattr(held, "NUMBERED", 1 << 20)
    assert {tuple(r) for r in G.rank(t, nodes).collect()} == want and walks


def test_closure_held_as_numbers_writes_no_pairs(spark, monkeypatch):
    edges = spark.createDataFrame(PAIRS["deep"], "src string, dst string")
    monkeypatch.setattr(held, "HELD_BYTES", 1)
    monkeypatch.setattr(held, "NUMBERED", 1 << 20)
    tags = []
    monkeypatch.setattr(G, "materialize", lambda df, tag, f=G.materialize: tags.append(tag) or f(df, tag))
    assert {(r.src, r.dst): r.d for r in G.closure(edges).collect()} == reach(PAIRS["deep"]) and tags == ["edges"]


@pytest.mark.parametrize("levels", [3, 31])
def test_a_block_gives_a_target_with_its_starts_in_one_run(monkeypatch, levels):
    rng = random.Random(6)
    pairs = sorted({(f"{a:03d}", f"{b:03d}") for a, b in (sorted((rng.randrange(300), rng.randrange(300))) for _ in range(1200)) if a != b} | {("298", "299"), ("299", "298")})
    monkeypatch.setattr(G, "LEVELS", levels)
    monkeypatch.setattr(G, "BATCH_PAIRS", 5000)
    names = sorted({x for p in pairs for x in p})
    ends = [np.array([names.index(p[k]) for p in pairs], np.int32) for k in (0, 1)]
    batches = list(G._pairs_of_block(held.Digraph.by_components(pa.array(names), *ends), np.arange(100, 230)))
    rows = [(r["src"], r["dst"], r["d"]) for b in batches for r in b.to_pylist()]
    got, want = {(a, b): d for a, b, d in rows}, reach(pairs)
    starts = {a for a, _ in got}
    assert len(got) == len(rows) and len(starts) > 120 and got == {p: d for p, d in want.items() if p[0] in starts}
    assert max(len(b) for b in batches) <= 5000
    runs = 1 + sum(a[1] != b[1] for a, b in zip(rows, rows[1:]))
    assert runs == len({(b, (d - 1) // levels) for _, b, d in rows})
