"""Commands, tools, embedding engines, the context card and exports."""

import io
import json
import subprocess

import numpy as np
import pytest

from callatlas import cli, server
from callatlas.operators import embedding as E
from callatlas.operators import graph as G
from callatlas.operators import relational as R
from callatlas.operators.context import context
from callatlas.plans import graph_query as Q
from callatlas.sources import git
from callatlas.sources import tables as T

FILES = {
    "Shop/OrderService.cs": """namespace Shop.Services;
public class OrderService
{
    private readonly OrderRepository _orders;
    public bool Process(int id, bool force)
    {
        if (id > 0 && force) { foreach (var x in Lines(id)) { if (x > 3) { _orders.Save(x); } } }
        return Check(id);
    }
    public bool Check(int id) { return id > 1 ? true : false; }
    private int[] Lines(int id) { return new[] { id }; }
    public void Unused() { }
}
""",
    "Shop/OrderRepository.cs": """namespace Shop.Infrastructure;
public class OrderRepository
{
    public void Save(int id) { Write(id); }
    public void Write(int id) { }
    public void Store(int id) { Write(id); }
}
""",
    "Shop/OrderController.cs": """namespace Shop.Controllers;
public class OrderController
{
    private OrderService _service;
    public bool Post(int id) { return _service.Process(id, true); }
}
""",
    "Shop/OrderServiceTests.cs": """namespace Shop.Tests;
public class OrderServiceTests { public void Process_Test() { new OrderService().Process(1, false); } }
""",
}


def sh(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("shop")
    repo, store = base / "code", base / "store"
    for name, text in FILES.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(text)
    sh(repo, "init", "-q")
    sh(repo, "add", ".")
    sh(repo, "commit", "-qm", "one")
    assert cli.main(["--root", str(store), "analyze", str(repo), "--save-baseline"]) == 0
    path = repo / "Shop/OrderRepository.cs"
    path.write_text(FILES["Shop/OrderRepository.cs"].replace("Write(id); }\n    public void Write", "Write(id + 1); }\n    public void Write"))
    sh(repo, "commit", "-qam", "two")
    return str(repo), str(store)


def test_store_of_sources(spark, place):
    t = T.load(spark, place[1])
    rows = {r.method_id: (r.cognitive_complexity, r.nesting_depth, r.blast_radius, r.blast_depth) for r in t.metrics.collect()}
    assert rows["Shop.Services.OrderService.Process(int, bool)"] == (1 + 1 + 2 + 3, 3, 2, 1)
    assert rows["Shop.Infrastructure.OrderRepository.Write(int)"][2:] == (5, 3)
    assert t.clone_pairs.count() >= 0 and {r.layer for r in t.type_layers.collect()} >= {"Infrastructure", "Presentation"}
    assert {r.key for r in t.metadata.collect()} >= {"analyzed_at", "commit", "built"}


def test_commands(spark, place, capsys, tmp_path):
    repo, store = place
    doc = tmp_path / "q.json"
    doc.write_text('{"seed": {"methodPattern": "Process("}, "expand": {"direction": "callees"}}')
    runs = {
        ("churn", repo, "--since", "1 year ago"): "OrderService.Process", ("diff", repo): "OrderRepository.Save", ("diff", repo, "--complex"): "", ("semantic-search", "order process"): "Process",
        ("query", "--query-file", str(doc)): "Lines", ("query", "--seed", "*Check*", "--direction", "callers", "--rank", "complexity"): "Post", ("query", "--schema"): "methodPattern",
        ("context", "OrderService.Process"): "OrderController", ("impact", "OrderService.Check"): "Post", ("dead-code",): "Unused", ("drift",): "", ("status",): "9", ("layers",): "Presentation",
    }
    for args, part in runs.items():
        assert cli.main(["--root", store, *args]) == 0
        assert part in capsys.readouterr().out, args
    with pytest.raises(ValueError):
        cli.main(["--root", store, "query"])


def test_git(spark, place):
    repo = place[0]
    assert [r.path.split("/")[-1] for r in git.changed_files(spark, repo).collect()] == ["OrderRepository.cs"]
    rows = git.commits(spark, repo).collect()
    assert len(rows) == 5 and {r.author for r in rows} == {"Ann"}
    (b,) = git.blame(spark, f"{repo}/Shop/OrderRepository.cs", 4).collect()
    assert b.author == "Ann" and git.blame(spark, f"{repo}/none.cs", 1).count() == 0 and len(git.head(repo)) == 40


def test_tools(spark, place):
    repo, store = place
    asked = {
        "cg_churn": ({"since": "1 year ago"}, "Process"), "cg_coupling": ({"level": "type"}, "OrderService"), "cg_diff": ({"format": "detail"}, "Save"), "cg_get_drift": ({}, ""), "cg_query": ({"seed": "*Process*", "expand": "callees", "depth": 99}, "Lines"),
        "cg_get_hotspots": ({"top": 1}, "Process"), "cg_get_callgraph": ({"method": "Process(", "direction": "callees", "depth": 1}, "Check"), "cg_get_tree": ({"include_private": True}, "Lines"), "cg_dead_code": ({}, "Unused"),
        "cg_get_impact": ({"method": "Check"}, "Post"), "cg_token_search": ({"query": "process int bool"}, "Process"), "cg_semantic_search": ({"query": "order save"}, "Save"), "cg_get_similar": ({"method": "Check"}, "("),
        "cg_get_duplicates": ({}, ""), "cg_get_clusters": ({}, ""), "cg_export_graph": ({}, "relationship_count"), "cg_get_context": ({"method": "Process("}, "n_callers"), "cg_analyze": ({"solution": repo}, "9"),
    }
    assert set(asked) == set(server.TOOLS) and len(asked) == 18
    lines = [{"id": 0, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 1, "method": "tools/list"}, {"id": 2, "method": "nothing"}, {"id": 3, "method": "tools/call", "params": {"name": "cg_get_impact"}}, {"id": 4, "method": "tools/call", "params": {"name": "none"}}]
    lines += [{"id": n, "method": "tools/call", "params": {"name": n, "arguments": a}} for n, (a, _) in asked.items()]
    out = io.StringIO()
    server.serve(spark, store, io.StringIO("\n".join(map(json.dumps, lines)) + "\n\n{bad\n"), out, repo)
    replies = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert replies[0]["result"]["protocolVersion"] == "2024-11-05" and len(replies[1]["result"]["tools"]) == 18 and replies[2]["error"]["code"] == -32601
    assert replies[3]["result"]["isError"] and replies[4]["result"]["isError"] and replies[None]["error"]["code"] == -32603
    for n, (_, part) in asked.items():
        got = replies[n]["result"]
        assert not got["isError"] and part in got["content"][0]["text"], (n, got)


def test_context_card(spark, place):
    repo, store = place
    t = T.load(spark, store)
    process = "Shop.Services.OrderService.Process(int, bool)"
    members = spark.createDataFrame([(i, "cluster-0") for i in (process, "Shop.Infrastructure.OrderRepository.Save(int)", "Shop.Services.OrderService.Check(int)")], "method_id string, cluster_id string")
    t = t.with_tables(method_cluster_map=members, intent_clusters=spark.createDataFrame([("cluster-0", "orders", 3, 0.5)], "id string, label string, member_count int, cohesion float"))
    path = t.methods.where(t.methods.id == process).first()
    sources = spark.createDataFrame([(path.file_path, FILES["Shop/OrderService.cs"])], "path string, text string")
    commits = spark.createDataFrame([(r.file_path, d) for r in t.methods.select("file_path").distinct().collect() for d in (("2024-03-01",) if "Repository" in r.file_path else ("2024-02-01", "2024-03-08"))], "file_path string, ts string").selectExpr("file_path", "cast(ts as timestamp) as ts")
    blame = spark.createDataFrame([(path.file_path, path.start_line, "Ann", "2024-03-09")], "file_path string, line int, author string, ts string").selectExpr("file_path", "line", "author", "cast(ts as timestamp) as ts")
    zones = [{"pattern": "*Services.OrderService.Process*", "level": "RequireApproval", "reason": "core"}, {"pattern": "*.Check(*", "level": "Deprecated", "reason": "old"}]
    r = context(t, process, zones, commits=commits, sources=sources, blame=blame, now="2024-03-09 12:00:00").first()
    assert [n.split(" ")[1].split("(")[0].split(".", 1)[1] for n in r.entry_points] == ["Controllers.OrderController.Post", "Tests.OrderServiceTests.Process_Test"] and r.n_entry_points == 2
    assert r.n_callers == 2 and r.n_callees == 3 and r.cluster == "orders" and r.cluster_members == 3
    assert r.recent == ["Check (1d)", "Save (8d)"] and r.last_modified == "Ann on 2024-03-09"
    assert r.source.startswith("    public bool Process") and len(r.source.split("\n")) <= 20
    assert any(n.startswith("calls deprecated bool Shop.Services.OrderService.Check") for n in r.notes) and "layer violations: Application->Infrastructure" in r.notes and "[REQUIRES APPROVAL] core" in r.notes


def test_engines(spark, tmp_path):
    texts = spark.createDataFrame([(f"m{k}", f"word{k % 7} other word") for k in range(250)] + [("none", None)], "method_id string, text string")

    def make_session():
        return lambda ids: np.array([[i % 5, 1.0, 0.0] for i in ids], float)

    rows = {r.method_id: r.vector for r in E.ModelEngine(make_session, 3).embed(texts).collect()}
    ids = E.word_ids("word3 other word")
    want = np.array([[i % 5, 1.0, 0.0] for i in ids]).mean(0)
    assert np.allclose(rows["m3"], want / np.linalg.norm(want), atol=1e-6) and rows["none"] == [0, 0, 0] and len(rows) == 251

    def make_client():
        state = {"n": 0}

        def client(part):
            state["n"] += 1
            if state["n"] % 3:
                raise E.Busy
            return [(k, [float(len(t)), 1.0]) for k, t in reversed(list(enumerate(part)))]

        return client

    remote = {r.method_id: r.vector for r in E.RemoteEngine(make_client, 2, wait=0.0).embed(texts).collect()}
    assert remote["m3"] == [16.0, 1.0] and remote["none"] == [0.0, 1.0] and len(remote) == 251

    def broken():
        def client(part):
            raise OSError("down")

        return client

    with pytest.raises(Exception, match="down"):
        E.RemoteEngine(broken, 2, wait=0.0).embed(texts).collect()
    assert E.engine("model", model_path=str(tmp_path / "no.onnx")).name == "hash" and E.engine("remote").name == "hash" and E.engine("remote", make_client=make_client).name == "remote"
    with pytest.raises(ValueError):
        E.engine("other")
    vectors = E.engine(dims=64).embed(texts)
    assert vectors.count() == 250 and len(vectors.first().vector) == 64
    best = E.semantic_search(spark, vectors, "word3 other word", E.HashEngine(64), 40).collect()
    assert len(best) == 40 and {r.method_id for r in best if r.score > 0.999} == {f"m{k}" for k in range(250) if k % 7 == 3}
    assert E.semantic_search(spark, vectors, " ", E.HashEngine(64)).count() == 0


def test_index_and_cache(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "method_id string, vector array<float>")
    index = E.VectorIndex(df, 2).add(spark.createDataFrame([("c", [1.0, 1.0]), ("a", [0.0, 2.0])], "method_id string, vector array<float>"))
    assert [(r.method_id, round(r.score, 3)) for r in index.search([1.0, 0.0], 3).collect()] == [("c", 0.707), ("a", 0.0), ("b", 0.0)]
    with pytest.raises(Exception, match="invalid vector"):
        E.VectorIndex(df, 2).add(spark.createDataFrame([("d", [1.0])], "method_id string, vector array<float>")).vectors.collect()
    made = []
    cache = E.IndexCache()
    for _ in range(2):
        cache.get("s", lambda: made.append(1) or df)
    cache.drop("s")
    cache.drop("s")
    cache.get("s", lambda: made.append(1) or df)
    assert len(made) == 2


def test_export_files(spark, place, tmp_path):
    t = T.load(spark, place[1])
    for form in ("json", "csv", "parquet"):
        R.export(t, str(tmp_path / form), form)
        read = spark.read.option("header", "true").option("escape", '"') if form == "csv" else spark.read
        methods = read.format(form).load(str(tmp_path / form / "methods"))
        assert methods.count() == t.methods.count() and {r.id for r in methods.collect()} == {r.id for r in t.methods.collect()}
        counts = read.format(form).load(str(tmp_path / form / "counts")).first()
        assert int(counts.method_count) == 9 and int(counts.relationship_count) == t.method_calls.count()


def test_traversals(spark):
    pairs = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A"), ("E", "A")]
    t = T.GraphTables(spark).with_tables(methods=spark.createDataFrame([(x, f"v N.T.{x}()", x) for x in "ABCDE"], "id string, full_name string, name string"), method_calls=spark.createDataFrame(pairs, "caller_id string, callee_id string"))
    w = G.traverse(t, G.Traversal("A", "both", 1))
    assert w.nodes == [("A", 0), ("B", 1), ("C", 1), ("D", 1), ("E", 1)] and w.total_visited == 5
    assert w.edges == [("A", "B", "callees"), ("A", "C", "callees"), ("D", "A", "callers"), ("E", "A", "callers")]
    w = G.traverse(t, G.Traversal("A", "callees", 3, "bfs", 2))
    assert w.nodes == [("A", 0), ("B", 1)] and w.total_visited == 3  # the node that met the limit was marked
    assert G.traverse(t, G.Traversal("A", "callees", 3, "dfs")).nodes == [("A", 0), ("B", 1), ("D", 2), ("C", 1)]
    assert G.traverse(t, G.Traversal("no such")).total_visited == 0
    assert len(G.Traversal(" ", "up", 0, "x", 0).errors()) == 5 and G.Traversal("A").errors() == []
    with pytest.raises(ValueError):
        G.traverse(t, G.Traversal("A", max_depth=0))
    with pytest.raises(ValueError):
        G.rank(t, t.methods, weights=(0.5, 0.5, 0.5))


def test_query_results(spark, monkeypatch):
    from callatlas.operators import held

    pairs = [("A", "B"), ("B", "C"), ("C", "D"), ("X", "C"), ("D", "E"), ("E", "F")]
    ids = "ABCDEFX"
    t = T.GraphTables(spark).with_tables(
        methods=spark.createDataFrame([(x, f"v N.T.{x}{'Test' if x == 'D' else ''}()", x, "Private" if x == "B" else "Public") for x in ids], "id string, full_name string, name string, accessibility string"),
        method_calls=spark.createDataFrame(pairs, "caller_id string, callee_id string"), metrics=spark.createDataFrame([(x, k, k) for k, x in enumerate(ids)], "method_id string, cognitive_complexity int, blast_radius int"),
    )
    for size in (held.HELD_BYTES, -1):
        monkeypatch.setattr(held, "HELD_BYTES", size)
        q = Q.GraphQuery(Q.Seed(methodPattern="N.T."), Q.Expand("callees", 2))
        assert {r.id: r.depth for r in Q.run(t, q).nodes.collect()} == {"A": 0, "B": 1, "C": 2, "D": 2, "E": 2, "F": 2, "X": 0}  # from the first seed
        q = Q.GraphQuery(Q.Seed(methodId="A"), Q.Expand("callees", 3), Q.Filter(excludeTests=True, includeAccessibility=("public",)))
        found = Q.run(t, q)
        assert {r.id for r in found.nodes.collect()} == {"A", "C"} and found.total_matches() == 4
        assert found.edges.count() == 0  # every one touches a node that was dropped
    one = Q.execute(t, Q.GraphQuery(Q.Seed(methodId="A"), Q.Expand("none", 1, False), output=Q.Output(5, includeMetrics=False, includeLocation=False)))
    assert one.columns == ["id", "full_name", "depth", "complexity", "blast_radius", "rank_score"] and one.first().rank_score is None
    assert {r.id for r in Q.execute(t, Q.GraphQuery(Q.Seed(methodId="A"), Q.Expand("callees", 3, False))).collect()} == {"A", "B"}
    assert {r.id for r in Q.execute(t, Q.GraphQuery(Q.Seed(methodId="A"), Q.Expand("callees", 5), Q.Filter(minComplexity=2, maxComplexity=4))).collect()} == {"A", "C", "D", "E"}
    assert Q.validate(Q.GraphQuery(Q.Seed(methodId="A"), filter=Q.Filter(minComplexity=-1, maxComplexity=-2))) == ["filter.minComplexity: is below 0", "filter.maxComplexity: is below 0", "filter: minComplexity is over maxComplexity"]
