"""Calls come from the whole table: the graph queries against plain Python and against their SQL over all lines."""

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from callatlas.operators import similarity as S
from callatlas.operators.context import build
from callatlas.queries import QUERIES, SQL
from callatlas.sources.tables import GraphTables
from callatlas.sources.testdata import calls

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def edges(cyclic):
    t = pq.read_table(f"{SMALL}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).to_pylist()
    rows = sorted((r["l_orderkey"], r["l_linenumber"], r["l_partkey"], r["l_suppkey"]) for r in t)
    steps = {(x[2], y[2]) for x, y in zip(rows, rows[1:]) if x[0] == y[0]}
    return {(a, b) for a, b in steps if (a != b if cyclic else a < b)}


@pytest.mark.parametrize("cyclic", [False, True])
def test_calls_of_all_orders(spark, cyclic):
    got = [(int(r.caller_id), int(r.callee_id)) for r in calls(spark, SMALL, cyclic).collect()]
    assert len(got) == len(set(got)) and set(got) == edges(cyclic)


def test_closure_of_all_orders(spark):
    down, want = {}, set()
    for a, b in edges(False):
        down.setdefault(a, set()).add(b)
    for a in down:
        level, depth, seen = {a}, 0, {a}
        while level := {y for x in level for y in down.get(x, ())} - seen:
            depth += 1
            seen |= level
            want |= {(str(a), str(b), depth) for b in level}
    assert {tuple(r) for r in QUERIES["closure_pairs"](spark, SMALL).collect()} == want


def test_structural_pairs_of_all_members(spark):
    texts = {"a": "x y z w v", "b": "v w z y x", "c": "x y z w v u", "d": "u v w x y z", "e": "k", "f": " ();"}
    signatures = spark.createDataFrame(list(texts.items()), "method_id string, structural_signature string")
    members = S.structural_members(signatures)
    assert {tuple(r) for r in members.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")}
    got = sorted(tuple(r) for r in S.member_pairs(S.structural_clones(signatures).select("a", "b", "similarity"), members).collect())
    assert got == sorted([("a", "b", 1.0), ("c", "d", 1.0), *[(p, q, 0.833333) for p in "ab" for q in "cd"]])


def test_members_of_every_document(spark, db):
    rows = {r.id: r.rep for r in QUERIES["structural_members"](spark, SMALL).collect()}
    sizes = {r.rep: r.n_members for r in QUERIES["structural_classes"](spark, SMALL).collect()}
    assert Counter(rows.values()) == sizes


def test_build_pairs_identical_methods(spark):
    ids = [f"A.B.M{k}()" for k in range(3)]
    t = GraphTables(spark).with_tables(
        methods=spark.createDataFrame([(i, i, i) for i in ids], "id string, full_name string, name string"),
        normalized_methods=spark.createDataFrame([(i, "if ( a ) { b }", f"word{k}") for k, i in enumerate(ids)], "method_id string, structural_signature string, semantic_payload string"),
        embeddings=spark.createDataFrame([(i, [1.0, 0.5]) for i in ids], "method_id string, vector array<float>"),
    )
    pairs = build(t, full=False).clone_pairs.collect()
    assert len(pairs) == 3 and {(r.structural_similarity, r.clone_type) for r in pairs} == {(1.0, "Type1")}


def test_lines_of_code_of_every_document(spark, tmp_path):
    texts = [(1, "a\n/* b\n c */ d\n// e\n\n", 2), (2, None, 0), (3, "/* x */\ny", 1)]
    spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in QUERIES["lines_of_code"](spark, str(tmp_path)).collect()} == {(i, n) for i, _, n in texts}


def test_impact_makes_calls_once(spark, monkeypatch):
    from callatlas import queries

    want = {tuple(r) for r in QUERIES["impact"](spark, SMALL).collect()}
    made = []
    monkeypatch.setattr(queries, "calls", lambda *a: made.append("again") or 1 / 0)
    for name in ("impact", "impact_summary", "impact_by_depth", "impact_top", "entry_callers"):
        rows = QUERIES[name](spark, SMALL).collect()
        if name == "impact":
            assert {tuple(r) for r in rows} == want
    assert not made
