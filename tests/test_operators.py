"""Operators on the small fixture graphs with known results."""

import random

import pytest

from callatlas.functions import text as N
from callatlas.operators import architecture as A
from callatlas.operators import drift as D
from callatlas.operators import graph as G
from callatlas.operators import relational as R
from callatlas.operators import similarity as S
from callatlas.plans import graph_query as Q
from callatlas.sources import tables as T
from callatlas.sources.tables import GraphTables

METHODS = [
    ("TestNs.OrderService.ProcessOrder(String)", "ProcessOrder", "bool", "type1", 10, 60, "Public", "/test/OrderService.cs", 25, 50, 5),
    ("TestNs.OrderService.ValidateOrder(Int32)", "ValidateOrder", "bool", "type1", 70, 90, "Public", "/test/OrderService.cs", 8, 20, 2),
    ("TestNs.OrderService.SaveOrder()", "SaveOrder", "void", "type1", 100, 120, "Private", "/test/OrderService.cs", 3, 20, 1),
    ("TestNs.UserService.GetUser(Int32)", "GetUser", "User", "type2", 10, 30, "Public", "/test/UserService.cs", 5, 20, 2),
    ("TestNs.UserService.DeadMethod()", "DeadMethod", "void", "type2", 40, 50, "Public", "/test/UserService.cs", 2, 10, 1),
]
P, V, S_, U, X = (m[0] for m in METHODS)


@pytest.fixture(scope="module")
def shop(spark):
    m = spark.createDataFrame([(r[0], r[0], *r[1:]) for r in METHODS], "id string, full_name string, name string, return_type string, type_id string, start_line int, end_line int, accessibility string, file_path string, cc int, loc int, nd int")
    return GraphTables(spark).with_tables(
        projects=spark.createDataFrame([("proj1", "TestProject", "/test/test.csproj")], "id string, name string, file_path string"),
        namespaces=spark.createDataFrame([("ns1", "TestNs", "proj1")], "id string, full_name string, project_id string"),
        types=spark.createDataFrame([("type1", "OrderService", "TestNs.OrderService", "ns1", "Class"), ("type2", "UserService", "TestNs.UserService", "ns1", "Class")], "id string, name string, full_name string, namespace_id string, kind string"),
        methods=m,
        metrics=m.selectExpr("id method_id", "cc cognitive_complexity", "loc lines_of_code", "nd nesting_depth", "0 blast_radius"),
        method_calls=spark.createDataFrame([(P, V), (P, S_), (P, U), (V, U)], "caller_id string, callee_id string"),
    )


def edges_of(spark, pairs, names=None):
    names = names or sorted({x for p in pairs for x in p})
    return GraphTables(spark).with_tables(methods=spark.createDataFrame([(n, f"void A.B.{n}()", n) for n in names], "id string, full_name string, name string"), method_calls=spark.createDataFrame(pairs or [("", "")], "caller_id string, callee_id string").where("caller_id <> ''"))


def test_hotspots(shop):
    rows = R.hotspots(shop, 5).collect()
    assert [(r.id, r.cognitive_complexity, r.risk) for r in rows] == [(P, 25, 25.0), (V, 8, 8.0), (U, 5, 5.0), (S_, 3, 3.0), (X, 2, 2.0)]


def test_dead_code(shop):
    # the fixture's namespace doesn't hold "Tests", so the two methods without callers remain
    assert {(r.id, r.cognitive_complexity) for r in R.dead_code(shop).collect()} == {(P, 25), (X, 2)}


def test_impact(shop):
    found = G.impact(shop, U)
    assert {(r.id, r.depth, r.is_entry) for r in found.collect()} == {(U, 0, False), (P, 1, True), (V, 1, False)}
    assert tuple(G.impact_summary(found).first()) == (3, 1, 1)
    assert G.impact(shop, "no such method").count() == 0


def test_callgraph(shop):
    nodes, edges = G.callgraph(shop, P, 2)
    assert sorted(r.depth for r in nodes.collect()) == [0, 1, 1, 1]
    assert edges.count() == 8


def test_coupling_and_tree(shop):
    assert [tuple(r) for r in R.coupling(shop).collect()] == [("TestNs", 0, 0, 0.0, 0.0, 1.0)]
    rows = {(r.type, r.method) for r in R.tree(shop).collect()}
    assert rows == {("OrderService", "ProcessOrder"), ("OrderService", "ValidateOrder"), ("UserService", "DeadMethod"), ("UserService", "GetUser")}


def test_resolve(shop):
    assert [(r.id, r.kind, r.unique) for r in R.resolve_method(shop, "UserService.GetUser").collect()] == [(U, 2, True)]
    assert R.resolve_method(shop, "Order").count() == 3


@pytest.mark.parametrize("pairs,names,want", [
    ([("A", "B"), ("B", "C")], None, {"A": (0, 0, 0), "B": (1, 1, 1), "C": (1, 2, 2)}),
    ([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], None, {"A": (0, 0, 0), "B": (1, 1, 1), "C": (1, 1, 1), "D": (2, 3, 2)}),
    ([], ["A"], {"A": (0, 0, 0)}),
    ([("A", "B"), ("B", "A"), ("B", "C")], None, {"A": (1, 1, 0), "B": (1, 1, 0), "C": (1, 2, 1)}),
])
def test_blast_radius(spark, pairs, names, want):
    got = {r.id: (r.direct_callers, r.transitive_callers, r.blast_depth) for r in G.blast_radius(edges_of(spark, pairs, names)).collect()}
    assert got == want


def test_chain(spark):
    n = 300
    rows = {r.id: r for r in G.blast_radius(edges_of(spark, [(f"m{i}", f"m{i + 1}") for i in range(n - 1)])).collect()}
    assert (rows[f"m{n - 1}"].transitive_callers, rows[f"m{n - 1}"].blast_depth) == (n - 1, n - 1)


def test_traversals_against_plain_python(spark):
    rng = random.Random(3)
    pairs = sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)})
    t = edges_of(spark, pairs)
    for direction in G.DIRECTIONS:
        near = {}
        for a, b in pairs:
            if a != b:
                if direction != "callers":
                    near.setdefault(a, set()).add(b)
                if direction != "callees":
                    near.setdefault(b, set()).add(a)
        depth, todo = {"n1": 0}, ["n1"]
        while todo:
            x = todo.pop(0)
            for y in sorted(near.get(x, ())):
                if y not in depth and depth[x] < 3:
                    depth[y] = depth[x] + 1
                    todo.append(y)
        got = {r.id: r.depth for r in G.bfs(t.method_calls, spark.createDataFrame([("n1",)], "id string"), direction, 3).collect()}
        assert got == depth
        assert dict(G.walk(t, "n1", direction, 3)) == depth


def test_walk_order_and_cycle(spark):
    t = edges_of(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A")])
    assert [n for n, _ in G.walk(t, "A", order="dfs", max_depth=5)] == ["A", "B", "D", "C"]
    assert len(G.walk(t, "A", max_results=2)) == 2
    assert {r.id for r in G.bfs(t.method_calls, t.methods.where("id = 'A'").select("id"), "callees", 10).collect()} == set("ABCD")
    assert G.blast_radius_of(t.method_calls, "D") == 4  # on a cycle it counts itself
    assert "(*)" in G.print_tree([("A", "B"), ("B", "A")], "A")


def test_components_on_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(200, 201)]
    got = {}
    for r in G.components(spark.createDataFrame(pairs, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(1, 50)), list(range(100, 161)), [200, 201]]


def test_graph_query(spark, shop):
    q = Q.GraphQuery.from_json('{"seed": {"methodPattern": "*ProcessOrder*"}, "expand": {"direction": "callees", "maxDepth": 2}, "rank": {"strategy": "complexity"}, "output": {"maxResults": 3}}')
    cache = Q.PlanCache()
    assert [r.id for r in Q.execute(shop, q, cache).collect()] == [P, V, U]
    assert [r.id for r in Q.execute(shop, q, cache).collect()] == [P, V, U] and (cache.hits, cache.misses) == (1, 1)
    assert Q.GraphQuery.from_json(q.to_json()) == q
    bad = Q.GraphQuery(Q.Seed(methodId=" "), Q.Expand("none", 200), Q.Filter(includeTypes=("",), minComplexity=5, maxComplexity=1), output=Q.Output(0))
    assert len(Q.validate(bad)) == 6
    with pytest.raises(ValueError):
        Q.execute(shop, bad)


def test_plan_cache_expiry():
    now = [0.0]
    c = Q.PlanCache(size=2, ttl=10, clock=lambda: now[0])
    for k in "abc":
        c.put(k, k)
    assert c.get("a") is None and c.get("c") == "c"
    now[0] = 11
    assert c.get("c") is None


def test_layers_and_rules(spark):
    names = [("MyApp.Domain.UserEntity.GetUser()", "d"), ("MyApp.Infrastructure.UserRepository.Save()", "i"), ("MyApp.Services.UserService.ProcessUser()", "s"), ("MyApp.Controllers.UserController.Get()", "c")]
    ids = [n for n, _ in names]
    t = GraphTables(spark).with_tables(
        projects=spark.createDataFrame([("p", "MyApp")], "id string, name string"),
        namespaces=spark.createDataFrame([(f"n{k}", n.rsplit(".", 2)[0], "p") for n, k in names], "id string, full_name string, project_id string"),
        types=spark.createDataFrame([(f"t{k}", n.split(".")[2], f"n{k}") for n, k in names], "id string, name string, namespace_id string"),
        methods=spark.createDataFrame([(n, n, n.split(".")[-1][:-2], f"t{k}") for n, k in names], "id string, full_name string, name string, type_id string"),
        method_calls=spark.createDataFrame([(ids[0], ids[1]), (ids[2], ids[1])], "caller_id string, callee_id string"),
    )
    layers = A.detect_layers(t)
    got = {r.type_id.split(".")[-1]: (r.layer, r.confidence) for r in layers.collect()}
    assert got == {"UserEntity": ("Domain", 1.0), "UserRepository": ("Infrastructure", 1.0), "UserService": ("Application", 0.9), "UserController": ("Presentation", 1.0)}
    fine = {r.type_id.split(".")[-1]: r.confidence for r in A.refine_layers(t, layers).collect()}
    assert fine["UserEntity"] == 0.9 and fine["UserController"] == 1.0
    assert [(r.caller_id, r.rule) for r in A.violations(t).collect()] == [(ids[0], "Domain → Infrastructure")]
    zones = [{"pattern": "*.Domain.User*", "level": "DoNotModify", "reason": "r"}, {"pattern": "*.Domain.*", "level": "Deprecated", "reason": "s"}]
    assert [(r.id, r.level, r.warning) for r in A.protected(t.methods, zones).collect()] == [(ids[0], "DoNotModify", "[DO NOT MODIFY] r")]


def test_glob(spark):
    for name, pattern, want in [("MyApp.Domain.UserEntity", "*.Domain.*", True), ("MyApp.Domain.UserEntity", "*.Infrastructure.*", False), ("abc", "*", True), ("abc", "???", True), ("abcd", "???", False), ("a+b", "A+?", True)]:
        assert spark.createDataFrame([(name,)], "n string").select(N.glob("n", pattern)).first()[0] is want


def test_drift(spark, shop):
    old = shop.with_tables(methods=shop.methods.where(f"id <> '{X}'"), metrics=shop.metrics.withColumn("cognitive_complexity", shop.metrics.cognitive_complexity - 2))
    assert [r.id for r in D.new_methods(shop, old).collect()] == [X]
    assert D.removed_methods(shop, old).count() == 0
    assert {r.id for r in D.regressions(shop, old).collect()} == {V, S_, U, X}  # 23 to 25 is under a quarter
    assert D.verdict(shop, old) == 1 and D.verdict(shop, shop) == 0


def test_tokens(spark):
    for word, want in {"GetCustomerById": "Get Customer By Id", "removeTag": "remove Tag", "HTTPClient": "HTTP Client", "XMLParser": "XML Parser", "ID": "ID", "getURL": "get URL", "get_customer_id": "get customer id", "": "", "Get2ndItem": "Get 2 nd Item"}.items():
        assert " ".join(spark.createDataFrame([(word,)], "w string").select(N.tokenize(N.F.col("w"))).first()[0]) == want


def test_lines_of_code(spark):
    source = "int a;\n\n// c\n/* x\n y */ int b;\n/* one */\n/* two */ int c;\n  \n"
    assert spark.createDataFrame([(source,)], "s string").select(N.lines_of_code(N.F.col("s"))).first()[0] == 3


def test_vectors(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"v{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [("z", [0.0] * 8)]
    df = spark.createDataFrame(rows, "method_id string, vector array<float>")
    near = S.knn(df, 3).where("query_id = 'v1'").orderBy("rank").collect()
    assert [r.method_id for r in near][0] == "v1" and len(near) == 4
    assert [r.method_id for r in S.similar(df, "v1", 3).collect()] == [r.method_id for r in near][1:]
    path = str(tmp_path / "x.veci")
    T.write_vector_file(path, rows)
    assert T.read_vector_file(spark, path).count() == 61
    with pytest.raises(Exception, match="invalid vector"):
        S.check_vectors(spark.createDataFrame([("a", [float("nan")])], "method_id string, vector array<float>")).collect()


@pytest.mark.parametrize("cell", [2000, 5])
def test_structural_clones_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(S, "CELL_ROWS", cell)
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = [f"t{rng.randrange(12)}" for _ in range(10)]
        rows.append((f"m{i:02d}", " ".join(base)))
        if i % 3 == 0:
            rows.append((f"n{i:02d}", " ".join([*base, "extra"])))
    rows.append(("empty", "  ();"))
    got = {(r.a, r.b) for r in S.structural_clones(spark.createDataFrame(rows, "method_id string, structural_signature string")).collect()}
    classes = {}
    for i, s in rows:
        b = s.split()
        if i != "empty":
            k = (tuple(sorted(set(b))), len(b))
            classes[k] = min(classes.get(k, i), i)
    items = [(i, set(t), n) for (t, n), i in classes.items()]
    want = {tuple(sorted((a, b))) for k, (a, s, n) in enumerate(items) for b, u, m in items[k + 1 :] if len(s & u) / len(s | u) >= 0.8 and min(n, m) / max(n, m) >= 0.8}
    assert got == want and want


def test_vectors_over_several_shards(spark, monkeypatch):
    from callatlas.operators import shards

    rng = random.Random(7)
    rows = [(f"v{i:03d}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [("z", [0.0] * 6), ("short", [1.0]), (None, [1.0] * 6), ("none", None)]
    df = spark.createDataFrame(rows, "method_id string, vector array<float>")
    near, pairs = sorted(map(tuple, S.knn(df, 3).select("query_id", "rank", "method_id").collect())), {tuple(r) for r in S.near_pairs(df, 0.2).collect()}
    for name, value in (("LEAST_ROWS", 20), ("QUERY_ROWS", 7)):
        monkeypatch.setattr(shards, name, value)
    assert sorted(map(tuple, S.knn(df, 3).select("query_id", "rank", "method_id").collect())) == near
    assert {tuple(r) for r in S.near_pairs(df, 0.2).collect()} == pairs and pairs
    unit = {i: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v] for i, v in rows if i and v and len(v) == 6}
    cosine = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b]))
    assert pairs == {(a, b) for a in unit for b in unit if a < b and 1 - cosine(a, b) <= 0.2}
    for q in list(unit)[:20]:
        want = sorted(unit, key=lambda i: (-round(cosine(q, i), 6), i))[:4]
        assert [m for x, _, m in near if x == q] == want


def test_lsh_pairs_find_nearly_all(spark):
    rng = random.Random(10)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(f"v{i:03d}", [x + 0.25 * rng.gauss(0, 1) for x in base[i % 60]]) for i in range(300)]
    df = spark.createDataFrame(rows, "method_id string, vector array<double>")
    exact = {tuple(r) for r in S.near_pairs(df, 0.15).collect()}
    for size in (S.BUCKET_ROWS, 20):  # buckets of over 20 vectors are cut into cells
        found = {tuple(r) for r in S.lsh_pairs(df, 0.15, bucket_rows=size).collect()}
        assert found <= exact and len(found) >= 0.9 * len(exact) > 100


def test_cluster_numbers(spark):
    members = [(f"m{k}", c) for c, n in (("x", 3), ("b", 2), ("a", 2), ("q", 1)) for k in range(n)]
    got = {(r.cluster, r.cluster_id, r.member_count) for r in S.number_clusters(spark.createDataFrame(members, "method_id string, cluster string")).collect()}
    assert got == {("x", "cluster-0", 3), ("a", "cluster-1", 2), ("b", "cluster-2", 2), ("q", "cluster-3", 1)}


def test_hybrid(spark):
    s = spark.createDataFrame([("b", "a", 0.9), ("c", "d", 1.0)], "a string, b string, similarity double")
    m = spark.createDataFrame([("a", "b", 0.8), ("e", "f", 0.9)], "a string, b string, similarity double")
    assert {(r.method_id_a, r.method_id_b, r.hybrid_score, r.clone_type) for r in S.hybrid(s, m).collect()} == {("a", "b", 0.84, "Type2"), ("e", "f", 0.54, "Semantic")}


def test_dbscan_and_labels(spark):
    rows = [(f"App.Users.UserService.GetUser{k}()", [1.0, 0.01 * k]) for k in range(3)] + [(f"App.Orders.OrderStore.SaveOrder{k}()", [0.01 * k, 1.0]) for k in range(3)]
    df = spark.createDataFrame(rows, "method_id string, vector array<float>")
    members = S.dbscan(df, 0.1, 2)
    assert members.groupBy("cluster").count().count() == 2
    labels = {r.label for r in S.cluster_labels(members).collect()}
    assert labels == {"UserService operations", "OrderStore save operations"}
    assert all(r.cohesion > 0.99 for r in S.cohesion(df, members).collect())


def test_store_roundtrip(spark, shop, tmp_path):
    root = str(tmp_path)
    T.save(shop, root)
    T.save_baseline(spark, root)
    back = T.load(spark, root, "baseline")
    assert back.methods.count() == 5 and back.clone_pairs.count() == 0
    with pytest.raises(FileNotFoundError):
        T.load(spark, root, "none")
    up = T.upsert_blast(back.metrics.where(f"method_id <> '{P}'"), spark.createDataFrame([(P, 3, 1)], "method_id string, blast_radius int, blast_depth int"))
    assert {(r.method_id, r.cognitive_complexity, r.blast_radius) for r in up.where(f"method_id = '{P}'").collect()} == {(P, 0, 3)}


def test_hash_embedding_is_unit(spark):
    cells = S.hash_embedding(spark.createDataFrame([("a", "get user by id"), ("b", "")], "id string, t string"), "id", "t")
    rows = cells.collect()
    assert {r.id for r in rows} == {"a"} and abs(sum(r.val**2 for r in rows) - 1) < 1e-9
    assert [r.id for r in S.search_tokens(spark, cells, "get user by id").collect()] == ["a"]
    assert len(S.dense(cells).first().vector) == 384


def test_context_card(shop):
    from callatlas.operators.context import context

    r = context(shop, P).first()
    assert (r.cognitive_complexity, r.lines_of_code, r.nesting_depth, r.n_callees, r.n_callers) == (25, 50, 5, 3, 0)
    assert r.callees == sorted([S_, V, U]) and "high complexity" in r.notes


def test_build_and_cli(spark, shop, tmp_path, capsys):
    from callatlas import cli
    from callatlas.operators.context import build
    from callatlas.sources.tables import conform

    texts = spark.createDataFrame([(m[0], "if ( a ) { b ; c ; d }", "order user save") for m in METHODS], "method_id string, structural_signature string, semantic_payload string")
    t = build(shop.with_tables(normalized_methods=conform(texts, "normalized_methods")))
    T.save(t, str(tmp_path))
    assert {r.method_id: (r.blast_radius, r.blast_depth) for r in T.load(spark, str(tmp_path)).metrics.collect()}[U] == (2, 2)
    root = ["--root", str(tmp_path)]
    for args in (["hotspots"], ["--format", "json", "impact", "UserService.GetUser"], ["--format", "table", "layers"], ["duplicates"], ["clusters"], ["--format", "csv", "coupling"], ["query", '{"seed": {"namespace": "TestNs"}}'], ["save-baseline"], ["drift"], ["token-search", "order user save"]):
        assert cli.main([*root, *args]) == 0
    assert "ProcessOrder" in capsys.readouterr().out


def test_queries_meet_shards_in_tiles(spark, monkeypatch):
    rng = random.Random(14)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(f"v{i:03d}", base[i % 20]) for i in range(240)]  # 12 copies each
    df = spark.createDataFrame(rows, "method_id string, vector array<double>")
    tiles = []
    monkeypatch.setattr(S, "_tiles", lambda n, m, f=S._tiles: tiles.append((n, m)) or f(n, m))
    monkeypatch.setattr(S, "TILE", 500)
    assert [x.stop - x.start for x in S._tiles(5, 240)] == [2, 2, 2] and tiles == [(5, 240)]
    got = {(r.query_id, r["rank"]): r.method_id for r in S.knn(df, 3).collect()}
    assert got == {(f"v{i:03d}", k + 1): f"v{i % 20 + 20 * k:03d}" for i in range(240) for k in range(4)}
    buckets = {}
    for r in S.lsh_buckets(df).collect():
        buckets.setdefault(r.bucket, set()).add(r.id)
    want = {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}
    found = [tuple(r) for r in S.lsh_candidates(df).collect()]
    assert len(found) == len(want) and set(found) == want
    twice = [tuple(r) for r in S.lsh_candidates(df.union(df.limit(30))).collect()]
    assert len(twice) == len(want) and set(twice) == want


def test_sets_go_by_their_digests(spark):
    df = spark.createDataFrame([("b", "x y x"), ("a", "y;x(x"), ("c", "x y"), ("d", " ;"), ("e", "xy x")], "method_id string, structural_signature string")
    out = S.structural_members(df)
    assert {tuple(r) for r in out.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("e", "e")}
    assert "array_distinct" not in out._jdf.queryExecution().toString()  # texts are read once


def test_pairs_at_the_threshold_pass_the_sketch(spark):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    df = spark.createDataFrame([("a", words(0, 450)), ("b", words(50, 500)), ("c", words(51, 501)), ("d", words(900, 905)), ("e", words(900, 904))], "method_id string, structural_signature string")
    out = S.structural_clones(df)
    assert {(r.a, r.b) for r in out.collect()} == {("a", "b"), ("b", "c"), ("d", "e")}
    assert "bit_count" in out._jdf.queryExecution().toString()


def test_save_sorts_only_repeated_keys(spark, shop, tmp_path, monkeypatch):
    first = T.first_wins
    monkeypatch.setattr(T, "first_wins", lambda df, keys, order=None: 1 / 0)
    T.save(shop, str(tmp_path / "a"))
    T.save_baseline(spark, str(tmp_path / "a"))
    assert T.load(spark, str(tmp_path / "a"), "baseline").methods.count() == shop.methods.count()
    monkeypatch.setattr(T, "first_wins", first)
    twice = shop.with_tables(methods=shop.methods.union(shop.methods.selectExpr("id", "'zz'", *[c for c in shop.methods.columns if c not in ("id", "name")])) if shop.methods.columns[:2] == ["id", "name"] else shop.methods.union(shop.methods))
    T.save(twice, str(tmp_path / "b"))
    assert {tuple(r) for r in T.load(spark, str(tmp_path / "b")).methods.collect()} == {tuple(r) for r in first(twice.methods, ["id"]).collect()}
