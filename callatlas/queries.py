"""The operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callatlas.functions import text as N
from callatlas.operators import architecture as A
from callatlas.operators import drift as D
from callatlas.operators import embedding as E
from callatlas.operators import graph as G
from callatlas.operators import relational as R
from callatlas.operators import similarity as S
from callatlas.plans import graph_query as Q
from callatlas.sources import tables as T
from callatlas.sources.scratch import materialize, scratch_path
from callatlas.sources.testdata import calls, graph, read
from callatlas.streaming.churn import windowed_commits

Query = Callable[[SparkSession, str], DataFrame]
CUTOFF = "1996-01-01"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LAYER_OF = {"Presentation": ["AMERICA.*"], "Application": ["ASIA.*"], "Domain": ["EUROPE.*"], "Infrastructure": ["AFRICA.*"], "Shared": ["MIDDLE_EAST.*"]}
RULES = [{"name": "america to europe", "from": "*AMERICA.*", "to": "*EUROPE.*"}, {"name": "asia to any", "from": "*ASIA.*", "to": "*", "severity": "Warning"}, {"name": "fine", "from": "*", "to": "*", "type": "Allowed"}]
ZONES = [{"pattern": "*AMERICA.NATION_6*", "level": "DoNotModify", "reason": "a", "owner": "b"}, {"pattern": "*AMERICA.*", "level": "RequireApproval", "reason": "c"}, {"pattern": "*ASIA.*", "level": "Deprecated", "reason": "d"}]

_PLACES = """places AS (SELECT s_suppkey, replace(r_name,' ','_')||'.'||replace(n_name,' ','_') AS ns, replace(s_name,' ','_') AS tname, CASE WHEN s_suppkey%7=0 THEN 'Interface' ELSE 'Class' END AS kind, r_name AS project, n_nationkey, n_regionkey
 FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"""


def _methods(name: str = "m", per: str = "lineitem") -> str:
    return f"""per_{name} AS (SELECT l_partkey, min(l_suppkey) AS s_suppkey, count(*) AS loc, count(DISTINCT l_linenumber) AS nesting FROM {per} GROUP BY 1),
{name} AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey, replace(p_name,' ','_')||'_'||p_partkey AS name, 'void '||ns||'.'||tname||'.'||replace(p_name,' ','_')||'_'||p_partkey||'()' AS full_name, CAST(s_suppkey AS VARCHAR) AS type_id,
 CAST(p_partkey%1000 AS INTEGER) AS start_line, '/src/'||tname||'.cs' AS file_path, p_size AS cc, CAST(loc AS INTEGER) AS loc, CAST(nesting AS INTEGER) AS nesting, CAST(p_partkey%90 AS INTEGER) AS br, ns, tname, kind, project, p_brand,
 CASE WHEN p_partkey%4=0 THEN 'Private' ELSE 'Public' END AS accessibility, p_partkey%11=0 AS is_override, p_partkey%13=0 AS is_abstract FROM part JOIN per_{name} ON p_partkey=l_partkey JOIN places USING (s_suppkey))"""


_CALLS = """calls AS (SELECT DISTINCT CAST(a AS VARCHAR) AS caller_id, CAST(b AS VARCHAR) AS callee_id FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey) AS b FROM lineitem) WHERE a<b)"""
_CYCLIC = _CALLS.replace("WHERE a<b)", "WHERE a<>b)").replace("calls AS", "cyc AS")
_BASE = f"WITH RECURSIVE {_PLACES}, {_methods()}, {_CALLS}"
_OLD = f"old AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}')), {_methods('b', 'old')}"
_TOP_CALLER = "seed AS (SELECT caller_id AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_TOP_CALLEE = "seed AS (SELECT callee_id AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _top(spark: SparkSession, sf_dir: str, end: str) -> str:
    row = calls(spark, sf_dir).groupBy(end).agg(F.count("*").alias("n")).orderBy(F.desc("n"), end).first()
    return row[0] if row else ""


def _called(spark: SparkSession, sf_dir: str) -> tuple[T.GraphTables, str]:
    """The tables, with calls made once, and the method that is called most."""
    t = graph(spark, sf_dir)
    made = materialize(t.method_calls, "calls")
    row = made.groupBy("callee_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee_id").first()
    return t.with_tables(method_calls=made), row[0] if row else ""


def _seed(spark: SparkSession, method_id: str) -> DataFrame:
    return spark.range(1).select(F.lit(method_id).alias("id"))


_HOT = "SELECT id, full_name, tname||'.cs' AS file, start_line, cc AS cognitive_complexity, loc AS lines_of_code, nesting AS nesting_depth, br AS blast_radius, round(cc*(1+ln(br+1)),4) AS risk FROM m ORDER BY {} LIMIT 20"
for _by, _order in (("complexity", "cc DESC, br DESC, id"), ("blast", "br DESC, cc DESC, id"), ("risk", "cc*(1+log10(br+1.0)) DESC, br DESC, id")):
    query(f"hotspots_{_by}", f"{_BASE} {_HOT.format(_order)}")(lambda s, d, by=_by: R.hotspots(graph(s, d), 20, by=by))
query("hotspots_threshold", f"{_BASE} SELECT * FROM ({_HOT.format('cc DESC, br DESC, id').replace('FROM m', 'FROM m WHERE cc >= 30')})")(lambda s, d: R.hotspots(graph(s, d), 20, 30))
query("method_search", f"{_BASE} SELECT id, name, full_name, file_path, start_line FROM m WHERE full_name ILIKE '%nation_6%blue_%'")(lambda s, d: R.search_methods(graph(s, d), "nation_6%blue_"))
query("method_info", f"{_BASE}, {_TOP_CALLEE} SELECT m.id, name, full_name, 'void' AS return_type, type_id, start_line, CAST(start_line+loc AS INTEGER) AS end_line, file_path, p_partkey%3=0 AS is_static, p_partkey%5=0 AS is_async, p_partkey%7=0 AS is_virtual, is_override, is_abstract, accessibility, cc AS cognitive_complexity, loc AS lines_of_code, nesting AS nesting_depth, br AS blast_radius, CAST(p_partkey%9 AS INTEGER) AS blast_depth FROM m JOIN seed ON m.id=seed.id")(lambda s, d: R.method_info(graph(s, d), _top(s, d, "callee_id")))
_TREE = "SELECT project, ns AS namespace, tname AS type, kind, name AS method, 'void' AS return_type, accessibility, id AS method_id FROM m WHERE accessibility='Public'"
query("tree", f"{_BASE} {_TREE}")(lambda s, d: R.tree(graph(s, d)))
query("tree_filtered", f"{_BASE} {_TREE} AND ns ILIKE 'A%' AND kind <> 'Interface' AND ns NOT ILIKE '%NATION_6%' AND ns NOT ILIKE '%NATION_12%'")(lambda s, d: R.tree(graph(s, d), namespace="A", skip_interfaces=True, skip_tests=True, exclude=("NATION_6", "NATION_12")))
query(
    "tree_top",
    f"{_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY project, ns, tname ORDER BY name, id) AS rn, count(*) OVER (PARTITION BY project, ns, tname) AS n FROM m WHERE accessibility='Public') SELECT project, ns AS namespace, tname AS type, string_agg(name, ',' ORDER BY rn) AS first_methods, CAST(max(n) AS BIGINT) AS n_methods, CAST(greatest(0, max(n)-3) AS BIGINT) AS more FROM r WHERE rn<=3 GROUP BY 1,2,3",
)(lambda s, d: R.tree_top(R.tree(graph(s, d)), 3))
_DEAD = "SELECT id, full_name, file_path, start_line, cc AS cognitive_complexity FROM m WHERE NOT EXISTS (SELECT 1 FROM calls WHERE callee_id=m.id)"
query("dead_code", f"{_BASE} {_DEAD} AND NOT is_override AND NOT is_abstract")(lambda s, d: R.dead_code(graph(s, d)))
query("dead_code_overrides", f"{_BASE} {_DEAD}")(lambda s, d: R.dead_code(graph(s, d), True))
_GROUPS = "g AS (SELECT id, {key} AS grp, kind, type_id FROM m), e AS (SELECT a.grp AS f, b.grp AS t FROM calls JOIN g a ON a.id=caller_id JOIN g b ON b.id=callee_id WHERE a.grp<>b.grp), c AS (SELECT grp, (SELECT count(*) FROM e WHERE t=grp) AS ca, (SELECT count(*) FROM e WHERE f=grp) AS ce, count(DISTINCT CASE WHEN kind='Interface' THEN type_id END)*1.0/count(DISTINCT type_id) AS a FROM g GROUP BY grp), i AS (SELECT *, CASE WHEN ca+ce>0 THEN ce*1.0/(ca+ce) ELSE 0 END AS i FROM c) SELECT grp, CAST(ca AS BIGINT) AS ca, CAST(ce AS BIGINT) AS ce, round_even(i::DOUBLE,4) AS instability, round_even(a::DOUBLE,4) AS abstractness, round_even(abs(a+i-1)::DOUBLE,4) AS distance FROM i"
query("coupling_namespace", f"{_BASE}, {_GROUPS.format(key='ns')}")(lambda s, d: R.coupling(graph(s, d)))
query("coupling_type", f"{_BASE}, {_GROUPS.format(key="ns||'.'||tname")}")(lambda s, d: R.coupling(graph(s, d), "type"))
query("export_methods", f"{_BASE} SELECT id, full_name, file_path, start_line, cc AS cognitive_complexity, loc AS lines_of_code, nesting AS nesting_depth, 'label '||label AS cluster_label FROM m LEFT JOIN embeddings ON id=CAST(vec_id AS VARCHAR)")(lambda s, d: R.export_methods(graph(s, d)))
query("export_concept", f"{_BASE} SELECT id, full_name, file_path, start_line, cc AS cognitive_complexity, loc AS lines_of_code, nesting AS nesting_depth, 'label '||label AS cluster_label FROM m JOIN embeddings ON id=CAST(vec_id AS VARCHAR) WHERE 'label '||label ILIKE '%label 3%'")(lambda s, d: R.export_methods(graph(s, d), "label 3"))
query("induced_calls", f"{_BASE}, k AS (SELECT id FROM m WHERE cc>=45) SELECT caller_id, callee_id FROM calls WHERE caller_id IN (SELECT id FROM k) OR callee_id IN (SELECT id FROM k)")(lambda s, d: R.induced_calls((t := graph(s, d)), t.metrics.where("cognitive_complexity >= 45").select(F.col("method_id").alias("id"))))
query("degrees", f"{_BASE} SELECT id, CAST(sum(i) AS BIGINT) AS afferent, CAST(sum(o) AS BIGINT) AS efferent FROM (SELECT caller_id AS id, 0 AS i, 1 AS o FROM calls UNION ALL SELECT callee_id, 1, 0 FROM calls) GROUP BY id")(lambda s, d: R.degrees(graph(s, d)))
query("callers", f"{_BASE}, {_TOP_CALLEE} SELECT caller_id AS id, CAST(1 AS INTEGER) AS depth FROM calls JOIN seed ON callee_id=id UNION ALL SELECT id, 0 FROM seed")(lambda s, d: G.bfs(calls(s, d), _seed(s, _top(s, d, "callee_id")), "callers", 1))
query("callees", f"{_BASE}, {_TOP_CALLER} SELECT callee_id AS id, CAST(1 AS INTEGER) AS depth FROM calls JOIN seed ON caller_id=id UNION ALL SELECT id, 0 FROM seed")(lambda s, d: G.bfs(calls(s, d), _seed(s, _top(s, d, "caller_id")), "callees", 1))
_BFS = "x AS ({edges}), w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT dst, depth+1 FROM w JOIN x ON src=id WHERE depth<{depth}) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id"
_DOWN, _UP = "SELECT caller_id AS src, callee_id AS dst FROM calls", "SELECT callee_id AS src, caller_id AS dst FROM calls"
query("bfs_callees_d3", f"{_BASE}, {_TOP_CALLER}, {_BFS.format(edges=_DOWN, depth=3)}")(lambda s, d: G.bfs(calls(s, d), _seed(s, _top(s, d, "caller_id")), "callees", 3))
query("bfs_callers_d3", f"{_BASE}, {_TOP_CALLEE}, {_BFS.format(edges=_UP, depth=3)}")(lambda s, d: G.bfs(calls(s, d), _seed(s, _top(s, d, "callee_id")), "callers", 3))
query("bfs_both_d3", f"{_BASE}, {_TOP_CALLEE}, {_BFS.format(edges=f'{_DOWN} UNION {_UP}', depth=3)}")(lambda s, d: G.bfs(calls(s, d), _seed(s, _top(s, d, "callee_id")), "both", 3))
#: All pairs with their least distance; a recursion keyed by pair, as path lengths without a key are too many.
_REACH = "r(src, dst, d) USING KEY (src, dst) AS (SELECT caller_id, callee_id, 1 FROM calls UNION (SELECT r.src, c.callee_id, min(r.d+1) FROM r JOIN calls c ON c.caller_id=r.dst LEFT JOIN recurring.r o ON o.src=r.src AND o.dst=c.callee_id WHERE o.src IS NULL GROUP BY 1,2))"
_ABOVE = f"{_TOP_CALLEE}, w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT caller_id, depth+1 FROM w JOIN calls ON callee_id=w.id), x AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"
query("impact", f"{_BASE}, {_ABOVE} SELECT x.id, m.full_name, CAST(x.depth AS INTEGER) AS depth, NOT EXISTS (SELECT 1 FROM calls WHERE callee_id=x.id) AS is_entry FROM x JOIN m ON m.id=x.id")(lambda s, d: G.impact(*_called(s, d)))
query("impact_summary", f"{_BASE}, {_ABOVE} SELECT count(*) AS affected, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM calls WHERE callee_id=x.id)) AS entry_points, CAST(max(depth) AS INTEGER) AS max_depth FROM x")(lambda s, d: G.impact_summary(G.impact(*_called(s, d))))
query("impact_by_depth", f"{_BASE}, {_ABOVE} SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n FROM x GROUP BY depth")(lambda s, d: G.impact(*_called(s, d)).groupBy("depth").agg(F.count("*").alias("n")))
query(
    "callgraph_edges",
    f"{_BASE}, {_TOP_CALLEE}, x AS ({_DOWN} UNION {_UP}), w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT dst, depth+1 FROM w JOIN x ON src=id WHERE depth<2), n AS (SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth)<2) SELECT caller_id, callee_id, count(*) AS n FROM (SELECT caller_id, callee_id FROM calls JOIN n ON caller_id=id UNION ALL SELECT caller_id, callee_id FROM calls JOIN n ON callee_id=id) GROUP BY 1,2",
)(lambda s, d: G.callgraph(graph(s, d), _top(s, d, "callee_id"), 2)[1].groupBy("caller_id", "callee_id").agg(F.count("*").alias("n")))
query("entry_points", f"{_BASE} SELECT id, full_name FROM m WHERE NOT EXISTS (SELECT 1 FROM calls WHERE callee_id=m.id)")(lambda s, d: R.entry_points(graph(s, d)))
query(
    "blast_radius_all",
    f"{_BASE}, {_REACH}, lg(id, depth) AS (SELECT DISTINCT caller_id, 0 FROM calls WHERE caller_id NOT IN (SELECT callee_id FROM calls) UNION SELECT callee_id, depth+1 FROM lg JOIN calls ON caller_id=lg.id), far AS (SELECT id, max(depth) AS far FROM lg GROUP BY id), ent AS (SELECT r.dst, m.full_name, row_number() OVER (PARTITION BY r.dst ORDER BY r.d, r.src) AS rn FROM r JOIN m ON m.id=r.src WHERE r.src NOT IN (SELECT callee_id FROM calls)), en AS (SELECT dst, string_agg(full_name, ',' ORDER BY rn) AS names FROM ent WHERE rn<=5 GROUP BY dst), nd AS (SELECT callee_id AS dst, count(*) AS n FROM calls GROUP BY 1), nt AS (SELECT dst, count(*) AS n FROM r GROUP BY 1) SELECT m.id, coalesce(nd.n,0) AS direct_callers, coalesce(nt.n,0) AS transitive_callers, CAST(coalesce(far,0) AS INTEGER) AS blast_depth, coalesce(names,'') AS entry_points FROM m LEFT JOIN en ON en.dst=m.id LEFT JOIN far ON far.id=m.id LEFT JOIN nd ON nd.dst=m.id LEFT JOIN nt ON nt.dst=m.id",
)(lambda s, d: G.blast_radius(graph(s, d)))
query("closure_pairs", f"{_BASE}, {_REACH} SELECT src, dst, CAST(d AS INTEGER) AS d FROM r")(lambda s, d: G.closure(G.directed(calls(s, d), "callees")))
query("closure_cyclic", f"WITH RECURSIVE {_CYCLIC}, s AS (SELECT callee_id AS id FROM cyc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), w(id) AS (SELECT caller_id FROM cyc JOIN s ON callee_id=s.id UNION SELECT caller_id FROM cyc JOIN w ON callee_id=w.id) SELECT count(*) AS blast_radius FROM w")(lambda s, d: _cyclic_blast(s, d))
query(
    "rank_combined",
    f"{_BASE}, {_REACH}, n AS (SELECT id FROM m WHERE cc>=40), b AS (SELECT dst AS id, count(*) AS br FROM r GROUP BY 1), c AS (SELECT id, count(*) AS coup FROM (SELECT caller_id AS id FROM calls UNION ALL SELECT callee_id FROM calls) GROUP BY 1), x AS (SELECT n.id, coalesce(b.br,0) AS br, m.cc, coalesce(c.coup,0) AS coup FROM n JOIN m ON m.id=n.id LEFT JOIN b ON b.id=n.id LEFT JOIN c ON c.id=n.id) SELECT id, round(0.4::DOUBLE*br/greatest(1,max(br) OVER ())+0.35::DOUBLE*cc/greatest(1,max(cc) OVER ())+0.25::DOUBLE*coup/greatest(1,max(coup) OVER ()),6) AS score FROM x",
)(lambda s, d: G.rank((t := graph(s, d)), t.metrics.where("cognitive_complexity >= 40").select(F.col("method_id").alias("id"))))
_GQ = Q.GraphQuery(Q.Seed(methodPattern="*NATION_6*"), Q.Expand("callees", 2), Q.Filter(excludeNamespaces=("NATION_12",), minComplexity=5, maxComplexity=45, includeAccessibility=("public",)), Q.Rank("combined"), Q.Output(50))
_FIRST = "w(id, seq, depth) AS (SELECT id, seq, 0 FROM seed UNION SELECT dst, seq, depth+1 FROM w JOIN x ON src=id WHERE depth<{depth}), n AS (SELECT id, arg_min(depth, seq*1000+depth) AS depth FROM w GROUP BY id)"
_ROWS = "m.id, full_name, CAST(depth AS INTEGER) AS depth, cc AS complexity, br AS blast_radius, {score} AS rank_score, loc, nesting, file_path, start_line AS line"
_GQ_KEPT = f"seed AS (SELECT id, row_number() OVER (ORDER BY id) AS seq FROM m WHERE full_name ILIKE '%NATION_6%'), x AS ({_DOWN}), {_FIRST.format(depth=2)}, kept AS (SELECT {_ROWS.format(score='round(cc*(1+ln(1+br)),6)')} FROM n JOIN m ON m.id=n.id WHERE depth=0 OR NOT (full_name ILIKE '%NATION_12%') AND cc BETWEEN 5 AND 45 AND accessibility='Public')"
query("graph_query_pattern", f"{_BASE}, {_GQ_KEPT} SELECT * FROM kept ORDER BY rank_score DESC, id LIMIT 50")(lambda s, d: Q.execute(graph(s, d), Q.GraphQuery.from_json(_GQ.to_json())))
query("graph_query_edges", f"{_BASE}, {_GQ_KEPT} SELECT caller_id AS from_id, callee_id AS to_id, 'callees' AS direction FROM calls JOIN n ON n.id=caller_id AND depth<2 WHERE caller_id NOT IN (SELECT id FROM m WHERE id IN (SELECT id FROM n) AND id NOT IN (SELECT id FROM kept)) AND callee_id NOT IN (SELECT id FROM m WHERE id IN (SELECT id FROM n) AND id NOT IN (SELECT id FROM kept))")(lambda s, d: Q.run(graph(s, d), _GQ).edges)
query("graph_query_total", f"{_BASE}, {_GQ_KEPT} SELECT count(*) AS total_matches FROM n")(lambda s, d: s.range(1).select(F.lit(Q.run(graph(s, d), _GQ).total_matches()).cast("long").alias("total_matches")))
query(
    "graph_query_cluster",
    f"{_BASE}, cl AS (SELECT label FROM embeddings WHERE 'label '||label ILIKE '%label%' GROUP BY label ORDER BY count(*) DESC, 'cluster-'||label LIMIT 1), seed AS (SELECT CAST(vec_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) AS seq FROM embeddings JOIN cl USING (label)), x AS ({_UP}), {_FIRST.format(depth=1)} SELECT {_ROWS.format(score='CAST(br AS DOUBLE)')} FROM n JOIN m ON m.id=n.id ORDER BY rank_score, m.id LIMIT 20",
)(lambda s, d: Q.execute(graph(s, d), Q.GraphQuery(Q.Seed(cluster="label"), Q.Expand("callers", 1), rank=Q.Rank("blastRadius", False))))
_V = "v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_COS = "list_cosine_similarity(a.e, b.e)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("method_id"), F.col("embedding").alias("vector"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored clone pairs: the semantic ones of the embeddings."""
    p = S.semantic_clones(_vectors(spark, sf_dir), 0.4)
    return p.select("method_id_a", "method_id_b", F.lit(0.0).alias("structural_similarity"), "semantic_similarity", (F.col("semantic_similarity") * 0.5 + 0.5).alias("hybrid_score"), F.lit("Semantic").alias("clone_type"))


_KNN = f"{_V}, k AS (SELECT a.id AS query_id, b.id AS method_id, {_COS} AS score, row_number() OVER (PARTITION BY a.id ORDER BY round({_COS},6) DESC, b.id) AS rank FROM v a, v b)"
_SEM = f"{_KNN}, sem AS (SELECT least(query_id, method_id) AS a, greatest(query_id, method_id) AS b, max(score) AS s FROM k WHERE rank<=11 AND query_id<>method_id AND score>=0.4 GROUP BY 1,2)"
query("knn_topk", f"WITH {_KNN} SELECT query_id, method_id, CAST(rank AS INTEGER) AS rank, round(score,4) AS score FROM k WHERE rank<=11")(lambda s, d: S.knn(_vectors(s, d), 10).select("query_id", "method_id", "rank", F.round("score", 4).alias("score")))
query("semantic_clones", f"WITH {_SEM} SELECT a AS method_id_a, b AS method_id_b, round(s,4) AS semantic_similarity FROM sem")(lambda s, d: S.semantic_clones(_vectors(s, d), 0.4).withColumn("semantic_similarity", F.round("semantic_similarity", 4)))
query("similar", f"WITH {_V} SELECT b.id AS method_id, round(list_cosine_similarity(a.e,b.e),4) AS score FROM v a, v b WHERE a.id='7' AND b.id<>'7' ORDER BY list_cosine_similarity(a.e,b.e) DESC, b.id LIMIT 10")(lambda s, d: S.similar(S.check_vectors(_vectors(s, d)), "7", 10).withColumn("score", F.round("score", 4)))
query("clone_pairs_concept", f"WITH {_SEM} SELECT DISTINCT a AS method_id_a, b AS method_id_b FROM sem JOIN v ON v.id IN (a, b) WHERE 'label '||label ILIKE '%label 3%'")(lambda s, d: R.clone_pairs(graph(s, d).with_tables(clone_pairs=_pairs(s, d)), 0.1, "Semantic", "label 3").select("method_id_a", "method_id_b"))
query("method_duplicates", f"{_BASE}, {_SEM}, one AS (SELECT a AS id FROM sem ORDER BY s DESC, a LIMIT 1) SELECT o.other_id, coalesce(m.full_name, o.other_id) AS other_name FROM (SELECT CASE WHEN a=id THEN b ELSE a END AS other_id FROM sem JOIN one ON id IN (a,b)) o LEFT JOIN m ON m.id=o.other_id")(lambda s, d: _duplicates(s, d))
query("drift_new_duplicates", f"WITH {_SEM} SELECT a AS method_id_a, b AS method_id_b FROM sem WHERE NOT (a IN (SELECT id FROM v WHERE label<5) AND b IN (SELECT id FROM v WHERE label<5))")(lambda s, d: _new_duplicates(s, d))


def _cyclic_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir, True)
    top = c.groupBy("callee_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee_id").first()
    return spark.range(1).select(F.lit(G.blast_radius_of(c, top[0]) if top else 0).cast("long").alias("blast_radius"))


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialize(_pairs(spark, sf_dir), "pairs")
    first = pairs.orderBy(F.desc("semantic_similarity"), "method_id_a").first()
    return R.duplicates_of(graph(spark, sf_dir).with_tables(clone_pairs=pairs), first[0] if first else "").select("other_id", "other_name")


def _new_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = graph(spark, sf_dir).with_tables(clone_pairs=_pairs(spark, sf_dir))
    old = read(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").cast("string").alias("id"))
    kept = now.clone_pairs.join(old.withColumnRenamed("id", "method_id_a"), "method_id_a", "left_semi").join(old.withColumnRenamed("id", "method_id_b"), "method_id_b", "left_semi")
    return D.new_duplicates(now, now.with_tables(clone_pairs=kept)).select("method_id_a", "method_id_b")


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("method_id"), F.col("text").alias("structural_signature"))


_CLASSES = r"""bag AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(text, '[ (){};,\n\r\t]+'), lambda t: t <> '') AS b FROM documents),
cls AS (SELECT list_sort(list_distinct(b)) AS t, len(b) AS n_bag, min(id) AS rep, count(*) AS n_members FROM bag WHERE len(b)>0 GROUP BY 1,2)"""
query("structural_classes", f"WITH {_CLASSES} SELECT rep, CAST(n_bag AS INTEGER) AS n_bag, CAST(len(t) AS INTEGER) AS n_tokens, n_members FROM cls")(lambda s, d: S.structural_classes(_signatures(s, d)).select("rep", "n_bag", F.size("tokens").alias("n_tokens"), "n_members"))
query("structural_members", f"WITH {_CLASSES} SELECT bag.id, cls.rep FROM bag JOIN cls ON list_sort(list_distinct(b))=t AND len(b)=n_bag")(lambda s, d: S.structural_members(_signatures(s, d)))
query(
    "structural_clones",
    f"WITH {_CLASSES}, w AS (SELECT rep, n_bag, len(t) AS n, unnest(t) AS tok FROM cls), p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c, min(x.n) AS na, min(y.n) AS nb, min(x.n_bag) AS ba, min(y.n_bag) AS bb FROM w x JOIN w y ON x.tok=y.tok AND x.rep<y.rep AND least(x.n,y.n)>=0.8*greatest(x.n,y.n) AND least(x.n_bag,y.n_bag)>=0.8*greatest(x.n_bag,y.n_bag) GROUP BY 1,2) SELECT a, b, round(c*1.0::DOUBLE/(na+nb-c),6) AS similarity, CASE WHEN c*1.0::DOUBLE/(na+nb-c)>0.95 THEN 'Type1' ELSE 'Type2' END AS clone_type FROM p WHERE c*1.0::DOUBLE/(na+nb-c)>=0.8",
)(lambda s, d: S.structural_clones(_signatures(s, d)))
_STRUCT = f"{_CLASSES}, w AS (SELECT rep, n_bag, len(t) AS n, unnest(t) AS tok FROM cls), p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c, min(x.n) AS na, min(y.n) AS nb FROM w x JOIN w y ON x.tok=y.tok AND x.rep<y.rep AND least(x.n,y.n)>=0.8*greatest(x.n,y.n) AND least(x.n_bag,y.n_bag)>=0.8*greatest(x.n_bag,y.n_bag) GROUP BY 1,2), st AS (SELECT a, b, round(c*1.0::DOUBLE/(na+nb-c),6) AS s FROM p WHERE c*1.0::DOUBLE/(na+nb-c)>=0.8)"
query(
    "hybrid_scores",
    f"WITH {_SEM}, {_STRUCT}, h AS (SELECT coalesce(st.a,sem.a) AS a, coalesce(st.b,sem.b) AS b, coalesce(st.s,0) AS s, coalesce(sem.s,0) AS m FROM st FULL JOIN sem ON st.a=sem.a AND st.b=sem.b) SELECT a AS method_id_a, b AS method_id_b, s AS structural_similarity, round(m,4) AS semantic_similarity, round(0.4*s+0.6*m,4) AS hybrid_score, CASE WHEN s>0.95 THEN 'Type1' WHEN s>0.8 THEN 'Type2' ELSE 'Semantic' END AS clone_type FROM h WHERE round(0.4*s+0.6*m,6)>=0.25",
)(lambda s, d: _hybrid(s, d))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural pairs of the documents and semantic ones of the embeddings, by their numbers."""
    st = S.structural_clones(_signatures(spark, sf_dir)).select("a", "b", "similarity")
    sem = S.semantic_clones(_vectors(spark, sf_dir), 0.4).select(F.col("method_id_a").alias("a"), F.col("method_id_b").alias("b"), F.col("semantic_similarity").alias("similarity"))
    return S.hybrid(st, sem, least=0.25).withColumn("semantic_similarity", F.round("semantic_similarity", 4)).withColumn("hybrid_score", F.round("hybrid_score", 4))


query("clone_member_pairs", f"WITH {_SEM}, {_STRUCT}, mem AS (SELECT bag.id, cls.rep FROM bag JOIN cls ON list_sort(list_distinct(b))=t AND len(b)=n_bag) SELECT sem.a, sem.b, CASE WHEN x.rep=y.rep THEN 1.0::DOUBLE ELSE st.s END AS similarity FROM sem JOIN mem x ON x.id=sem.a JOIN mem y ON y.id=sem.b LEFT JOIN st ON st.a=least(x.rep,y.rep) AND st.b=greatest(x.rep,y.rep) WHERE x.rep=y.rep OR st.s IS NOT NULL")(lambda s, d: _member_pairs(s, d))


def _member_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sem = S.semantic_clones(_vectors(spark, sf_dir), 0.4).select(F.col("method_id_a").alias("a"), F.col("method_id_b").alias("b"))
    return S.pairs_among(sem, S.structural_clones(_signatures(spark, sf_dir)), S.structural_members(_signatures(spark, sf_dir)))


query(
    "dbscan_clusters",
    f"WITH RECURSIVE {_V}, p AS (SELECT a.id AS a, b.id AS b FROM v a, v b WHERE a.id<>b.id AND 1-list_cosine_similarity(a.e,b.e)<=0.6), core AS (SELECT a AS id FROM p GROUP BY a HAVING count(*)>=2), cc AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), w(id, root) AS (SELECT id, id FROM core UNION SELECT cc.b, w.root FROM w JOIN cc ON cc.a=w.id), co AS (SELECT id, min(root) AS cluster FROM w GROUP BY id) SELECT id AS method_id, cluster FROM co UNION ALL SELECT p.a, min(co.cluster) FROM p JOIN co ON p.b=co.id WHERE p.a NOT IN (SELECT id FROM core) GROUP BY p.a",
)(lambda s, d: S.dbscan(_vectors(s, d), 0.6, 2))
query("lsh_candidates")(lambda s, d: S.lsh_candidates(_vectors(s, d)))
query("lsh_pairs")(lambda s, d: S.lsh_pairs(_vectors(s, d), 0.6))
query("cluster_cohesion", f"WITH {_V} SELECT 'cluster-'||a.label AS cluster, round(avg(list_cosine_similarity(a.e,b.e)),4) AS cohesion FROM v a JOIN v b ON a.label=b.label AND a.id<>b.id GROUP BY a.label")(lambda s, d: S.cohesion(_vectors(s, d), graph(s, d).method_cluster_map.withColumnRenamed("cluster_id", "cluster")).withColumn("cohesion", F.round("cohesion", 4)))
query("cluster_numbers", "SELECT 'cluster-'||label AS cluster, count(*) AS member_count, 'cluster-'||(row_number() OVER (ORDER BY count(*) DESC, 'cluster-'||label)-1) AS cluster_id FROM embeddings GROUP BY label")(lambda s, d: S.number_clusters(graph(s, d).method_cluster_map.withColumnRenamed("cluster_id", "cluster")))
query("cluster_labels", f"{_BASE} SELECT p_brand AS cluster, arg_min(tname, (-n, lower(tname)))||' operations' AS label FROM (SELECT p_brand, tname, count(*) AS n FROM m GROUP BY 1,2) GROUP BY 1")(lambda s, d: S.cluster_labels(graph(s, d).methods.join(read(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("cluster")), "id").select("cluster", F.regexp_replace("full_name", r"\.[^.(]*\(", ".x(").alias("method_id"))))
_CELLS = r"""w AS (SELECT id, list_filter(string_split(text, ' '), lambda s: s <> '') AS w FROM src), t AS (SELECT id, unnest(w) AS t, 1.0::DOUBLE AS x FROM w UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i]||'_'||w[i+1])), 0.5 FROM w), h AS (SELECT id, x, sha256('0:'||t) AS h, sha256('1:'||t) AS g FROM t), c AS (SELECT id, CAST(CAST('0x'||h[7:8]||h[5:6]||h[3:4]||h[1:2] AS BIGINT)%384 AS INTEGER) AS idx, sum(CASE WHEN CAST('0x'||g[2:2] AS INTEGER)%2=1 THEN x ELSE -x END) AS x FROM h GROUP BY 1,2), n AS (SELECT id, sqrt(sum(x*x)) AS norm FROM c GROUP BY id), cell AS (SELECT id, idx, x/norm AS val FROM c JOIN n USING (id) WHERE x<>0)"""
query("hash_embedding", f"WITH src AS (SELECT item_id AS id, text FROM benchmark), {_CELLS} SELECT id, idx, round(val,6) AS val FROM cell")(lambda s, d: S.hash_embedding(read(s, d, "benchmark"), "item_id", "text").select("id", "idx", F.round("val", 6).alias("val")))
_ASKED = f"WITH src AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT -1, 'the and of'), {_CELLS}, sc AS (SELECT a.id, round(sum(a.val*q.val),6) AS score FROM cell a JOIN cell q ON a.idx=q.idx AND q.id=-1 WHERE a.id<>-1 GROUP BY 1)"
query("token_search", f"{_ASKED} SELECT * FROM (SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 10) WHERE score>=0.05")(lambda s, d: S.search_tokens(s, S.hash_embedding(read(s, d, "benchmark"), "item_id", "text"), "the and of", 10, 0.05))
query("semantic_search", f"{_ASKED} SELECT CAST(src.id AS VARCHAR) AS method_id, round(coalesce(score,0),4) AS score FROM src LEFT JOIN sc USING (id) WHERE src.id<>-1 AND EXISTS (SELECT 1 FROM cell WHERE cell.id=src.id) ORDER BY coalesce(score,0) DESC, method_id LIMIT 5")(lambda s, d: E.semantic_search(s, E.HashEngine().embed(read(s, d, "benchmark").select(F.col("item_id").cast("string").alias("method_id"), "text")), "the and of", k=5).withColumn("score", F.round("score", 4)))
query("layers", f"{_BASE} SELECT DISTINCT ns||'.'||tname AS type_id, CASE split_part(ns,'.',1) WHEN 'AMERICA' THEN 'Presentation' WHEN 'ASIA' THEN 'Application' WHEN 'EUROPE' THEN 'Domain' WHEN 'AFRICA' THEN 'Infrastructure' ELSE 'Shared' END AS layer, 1.0::DOUBLE AS confidence, 'Namespace pattern: '||split_part(ns,'.',1)||'.*' AS reason FROM m")(lambda s, d: A.detect_layers(graph(s, d), LAYER_OF))
_LY = "ly AS (SELECT DISTINCT ns||'.'||tname AS ty, CASE split_part(ns,'.',1) WHEN 'AMERICA' THEN 'Presentation' WHEN 'ASIA' THEN 'Application' WHEN 'EUROPE' THEN 'Domain' WHEN 'AFRICA' THEN 'Infrastructure' ELSE 'Shared' END AS layer FROM m), dep AS (SELECT DISTINCT a.ns||'.'||a.tname AS f, b.ns||'.'||b.tname AS t FROM calls JOIN m a ON a.id=caller_id JOIN m b ON b.id=callee_id WHERE a.ns||'.'||a.tname<>b.ns||'.'||b.tname), bad AS (SELECT f, count(*) AS n FROM dep JOIN ly x ON x.ty=f JOIN ly y ON y.ty=t WHERE x.layer<>y.layer AND NOT ((x.layer='Presentation' AND y.layer IN ('Application','Domain','Shared')) OR (x.layer='Application' AND y.layer IN ('Domain','Shared')) OR (x.layer='Domain' AND y.layer='Shared') OR (x.layer='Infrastructure' AND y.layer IN ('Domain','Shared'))) GROUP BY f)"
query("layers_refined", f"{_BASE}, {_LY} SELECT ty AS type_id, layer, CAST(round(CASE WHEN coalesce(n,0)>0 THEN greatest(0.1, 1-0.1*n) ELSE 1 END,6) AS DOUBLE) AS confidence FROM ly LEFT JOIN bad ON f=ty")(lambda s, d: A.refine_layers((t := graph(s, d)), A.detect_layers(t, LAYER_OF)).select("type_id", "layer", "confidence"))
query("type_dependencies", f"{_BASE}, {_LY} SELECT f AS from_type, t AS to_type FROM dep")(lambda s, d: A.type_dependencies(graph(s, d)))
_VIO = f"{_BASE}, vio AS (SELECT caller_id, callee_id, a.ns AS x, b.ns AS y FROM calls JOIN m a ON a.id=caller_id JOIN m b ON b.id=callee_id), hit AS (SELECT caller_id, callee_id, 'america to europe' AS rule, 'Error' AS severity FROM vio WHERE x LIKE 'AMERICA.%' AND y LIKE 'EUROPE.%' UNION ALL SELECT caller_id, callee_id, 'asia to any', 'Warning' FROM vio WHERE x LIKE 'ASIA.%')"
query("dep_violations", f"{_VIO} SELECT * FROM hit")(lambda s, d: A.violations(graph(s, d), RULES).select("caller_id", "callee_id", "rule", "severity"))
query("dep_violation_counts", f"{_VIO} SELECT rule, count(*) AS n, count(*) FILTER (WHERE severity='Error') AS errors, count(*) FILTER (WHERE severity='Warning') AS warnings FROM hit GROUP BY rule")(lambda s, d: A.violation_counts(A.violations(graph(s, d), RULES)))
query("calls_checked", f"{_BASE} SELECT count(*) AS calls_checked FROM calls WHERE caller_id IN (SELECT id FROM m)")(lambda s, d: A.calls_checked(graph(s, d)))
query("zones_first_match", f"{_BASE} SELECT id, full_name, CASE WHEN ns='AMERICA.NATION_6' THEN '*AMERICA.NATION_6*' WHEN ns LIKE 'AMERICA.%' THEN '*AMERICA.*' ELSE '*ASIA.*' END AS pattern, CASE WHEN ns='AMERICA.NATION_6' THEN 'DoNotModify' WHEN ns LIKE 'AMERICA.%' THEN 'RequireApproval' ELSE 'Deprecated' END AS level, CASE WHEN ns='AMERICA.NATION_6' THEN '[DO NOT MODIFY] a (Contact: b)' WHEN ns LIKE 'AMERICA.%' THEN '[REQUIRES APPROVAL] c' ELSE '[DEPRECATED] d' END AS warning FROM m WHERE ns LIKE 'AMERICA.%' OR ns LIKE 'ASIA.%'")(lambda s, d: A.protected(graph(s, d).methods, ZONES))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[T.GraphTables, T.GraphTables]:
    """Current and baseline with complexity taken from line counts and clusters from brands."""
    out = []
    brand = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("method_id"), F.col("p_brand").alias("cluster_id"))
    for t in (graph(spark, sf_dir), graph(spark, sf_dir, CUTOFF)):
        clusters = brand.select(F.col("cluster_id").alias("id"), F.col("cluster_id").alias("label")).distinct()
        out.append(t.with_tables(metrics=t.metrics.withColumn("cognitive_complexity", F.col("lines_of_code")), method_cluster_map=brand, intent_clusters=clusters))
    return out[0], out[1]


def _label_snapshots(spark: SparkSession, sf_dir: str) -> tuple[T.GraphTables, T.GraphTables]:
    """As _snapshots(), with only those members of a label that the snapshot has as methods."""
    return tuple(t.with_tables(method_cluster_map=t.method_cluster_map.join(t.methods.select(F.col("id").alias("method_id")), "method_id", "left_semi")) for t in _snapshots(spark, sf_dir))


_SNAP = f"WITH {_PLACES}, {_methods()}, {_OLD}"
_LATE = f"late AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{CUTOFF}')), {_methods('c', 'late')}"
query("drift_new", f"{_SNAP}, {_LATE} SELECT id, full_name FROM c WHERE id NOT IN (SELECT id FROM b)")(lambda s, d: D.new_methods(graph(s, d, since=CUTOFF), graph(s, d, CUTOFF)))
query("drift_removed", f"{_SNAP}, {_LATE} SELECT id, full_name FROM b WHERE id NOT IN (SELECT id FROM c)")(lambda s, d: D.removed_methods(graph(s, d, since=CUTOFF), graph(s, d, CUTOFF)))
query("drift_verdict", f"{_SNAP}, {_LATE} SELECT CASE WHEN EXISTS (SELECT 1 FROM c FULL JOIN b USING (id) WHERE c.full_name IS NULL OR b.full_name IS NULL) THEN 1 ELSE 0 END AS code, 0 AS same")(lambda s, d: s.range(1).select(F.lit(D.verdict(graph(s, d, since=CUTOFF), graph(s, d, CUTOFF))).alias("code"), F.lit(D.verdict(graph(s, d), graph(s, d))).alias("same")))
query("drift_new_members", f"{_SNAP} SELECT p_brand AS label, id FROM m WHERE id NOT IN (SELECT id FROM b) AND p_brand IN (SELECT p_brand FROM b)")(lambda s, d: D.new_members(*_label_snapshots(s, d)))
query("method_details", f"{_BASE} SELECT id, full_name, ns||'.'||tname AS type, ns AS namespace FROM m")(lambda s, d: D.method_details(graph(s, d)))
query("drift_regression", f"{_SNAP} SELECT id, b.loc AS base_cc, m.loc AS current_cc, round((m.loc-b.loc)*1.0::DOUBLE/b.loc,4) AS share FROM m JOIN b USING (id) WHERE m.loc>b.loc AND ((m.loc-b.loc)*1.0::DOUBLE/b.loc>=0.25 OR (b.loc<=15 AND m.loc>15))")(lambda s, d: D.regressions(*_snapshots(s, d)))
query("drift_scattering", f"{_SNAP} SELECT label, count(*) AS new_namespaces, string_agg(ns, ',' ORDER BY ns) AS namespaces, (SELECT count(*) FROM m WHERE p_brand=label AND id NOT IN (SELECT id FROM b)) AS new_members FROM (SELECT DISTINCT p_brand AS label, ns FROM m EXCEPT SELECT DISTINCT p_brand, ns FROM b) WHERE label IN (SELECT p_brand FROM b) GROUP BY label")(lambda s, d: D.scattering(*_label_snapshots(s, d)).withColumn("namespaces", F.array_join("namespaces", ",")))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = F.concat(F.lit("/src/Supplier#"), F.lpad((F.col("user_id") % 1000).cast("string"), 9, "0"), F.lit(".cs"))
    return read(spark, sf_dir, "events").select(supplier.alias("file_path"), F.col("ts").cast("timestamp").alias("ts"))


_COMMITS = "c AS (SELECT '/src/Supplier#'||lpad(CAST(user_id%1000 AS VARCHAR),9,'0')||'.cs' AS file_path, ts FROM events)"
query("churn", f"{_BASE}, {_COMMITS}, n AS (SELECT file_path, count(*) AS commits FROM c WHERE ts>=TIMESTAMP '2024-01-10' GROUP BY 1) SELECT id, full_name, file_path, commits, cc AS cognitive_complexity, CAST(commits*cc AS BIGINT) AS churn_score FROM m JOIN n USING (file_path) WHERE cc>0")(lambda s, d: R.churn(graph(s, d), _commits(s, d), "2024-01-10"))
query("churn_windows", f"WITH {_COMMITS} SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, file_path, count(*) AS commits FROM c GROUP BY 1,2")(lambda s, d: windowed_commits(_commits(s, d)))
query("diff", f"{_BASE} SELECT id, full_name, file_path, cc AS cognitive_complexity FROM m WHERE lower(file_path) IN (SELECT lower('/src/'||replace(s_name,' ','_')||'.cs') FROM supplier WHERE s_acctbal>5000)")(lambda s, d: R.diff(graph(s, d), read(s, d, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("/src/"), F.replace("s_name", F.lit(" "), F.lit("_")), F.lit(".cs")).alias("path"))))
query("summary", f"{_BASE} SELECT (SELECT count(*) FROM m) AS n_metrics, (SELECT round(avg(cc),4) FROM m) AS avg_complexity, (SELECT max(br) FROM m) AS max_blast, (SELECT count(*) FROM m WHERE br>10) AS n_high_impact, (SELECT count(*) FROM m) AS n_methods, (SELECT count(*) FROM places) AS n_types, (SELECT count(*) FROM calls) AS n_calls")(lambda s, d: R.summary(graph(s, d)))
query("relationships", f"{_BASE} SELECT CAST(n_regionkey AS VARCHAR) AS source_id, 'ns:'||n_nationkey AS target_id, 'Contains' AS kind FROM nation UNION ALL SELECT 'ns:'||n_nationkey, CAST(s_suppkey AS VARCHAR), 'Contains' FROM places UNION ALL SELECT type_id, id, 'Contains' FROM m")(lambda s, d: T.relationships(graph(s, d)))
query("upsert_metrics", f"{_BASE} SELECT id AS method_id, CASE WHEN p_partkey%3=0 THEN 0 ELSE cc END AS cognitive_complexity, CASE WHEN p_partkey%3=0 THEN 0 ELSE loc END AS lines_of_code, CASE WHEN p_partkey%3=0 THEN 0 ELSE nesting END AS nesting_depth, CASE WHEN p_partkey%2=0 THEN 7 WHEN p_partkey%3=0 THEN 0 ELSE br END AS blast_radius, CASE WHEN p_partkey%2=0 THEN 3 WHEN p_partkey%3=0 THEN 0 ELSE CAST(p_partkey%9 AS INTEGER) END AS blast_depth FROM m WHERE p_partkey%3<>0 OR p_partkey%2=0")(lambda s, d: _upsert(s, d))


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    key = F.col("method_id").cast("long")
    blast = t.metrics.where(key % 2 == 0).select("method_id", F.lit(7).alias("blast_radius"), F.lit(3).alias("blast_depth"))
    return T.upsert_blast(t.metrics.where(key % 3 != 0), blast)


query("tokenize", f"{_BASE} SELECT id, array_to_string(regexp_extract_all(name, '([A-Z]+[a-z]*|[a-z]+|[0-9]+)'), ' ') AS tokens FROM m")(lambda s, d: graph(s, d).methods.select("id", F.array_join(N.tokenize(F.col("name")), " ").alias("tokens")))
query("lines_of_code", r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(trim(l), '//'))) AS INTEGER) AS loc FROM documents WHERE NOT contains(text, '/*')")(lambda s, d: read(s, d, "documents").select("doc_id", N.lines_of_code(F.col("text")).alias("loc")))
query("group_keys", f"{_BASE} SELECT id, ns AS namespace_key, ns||'.'||tname AS type_key, tname||'.'||name AS tail, name AS short FROM m")(lambda s, d: graph(s, d).methods.select("id", N.group_key(F.col("full_name")).alias("namespace_key"), N.group_key(F.col("full_name"), "type").alias("type_key"), N.tail_name(F.col("full_name")).alias("tail"), N.short_name(F.col("full_name")).alias("short")))
query("first_wins", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda s, d: T.first_wins(read(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"]))
_NAMED = "SELECT x.asked, m.id, full_name, CAST({kind} AS INTEGER) AS kind, count(*) OVER (PARTITION BY x.asked)=1 AS unique FROM m JOIN ({names}) x ON {on}"
query(
    "resolve_method",
    f"{_BASE}, one AS (SELECT id, full_name, tname||'.'||name AS tail FROM m ORDER BY id LIMIT 1) "
    + " UNION ALL ".join(_NAMED.format(kind=k, names=f"SELECT {c} AS asked FROM one" if c != "nation" else "SELECT 'nation_6' AS asked", on=o) for k, c, o in ((0, "id", "m.id=x.asked"), (1, "full_name", "m.full_name=x.asked"), (2, "tail", "tname||'.'||name=x.asked"), (3, "nation", "full_name ILIKE '%NATION_6%'"))),
)(lambda s, d: _resolved(s, d))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method by id, by full name and by type and name, and all of a place."""
    t = graph(spark, sf_dir)
    first = t.methods.select("id", "full_name", N.tail_name(F.col("full_name")).alias("tail")).orderBy("id").first()
    return reduce(DataFrame.union, [R.resolve_method(t, n).select(F.lit(n).alias("asked"), "id", "full_name", "kind", "unique") for n in (*first, "nation_6")])


# orders, limits and what they leave out
query("tree_ordered", f"{_BASE}, r AS ({_TREE}) SELECT project, namespace, type, method, method_id, rank, (SELECT count(*) FROM r) AS total, greatest(0, (SELECT count(*) FROM r)-25) AS more FROM (SELECT *, CAST(row_number() OVER (ORDER BY project, namespace, type, method, method_id) AS INTEGER) AS rank FROM r) WHERE rank<=25")(lambda s, d: R.top_with_more(R.tree(graph(s, d)).select("project", "namespace", "type", "method", "method_id"), ["project", "namespace", "type", "method", "method_id"], 25))


def _top_sql(rows: str, order: str, n: int, with_: str = "") -> str:
    return f"{_BASE}{with_}, r AS ({rows}) SELECT *, (SELECT count(*) FROM r) AS total, greatest(0, (SELECT count(*) FROM r)-{n}) AS more FROM (SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM r) WHERE rank<={n}"


query("dead_code_top", _top_sql(f"{_DEAD}", "cognitive_complexity DESC, id", 10))(lambda s, d: R.top_with_more(R.dead_code(graph(s, d), True), [F.desc("cognitive_complexity"), "id"], 10))
query("impact_top", _top_sql("SELECT x.id, m.full_name, CAST(x.depth AS INTEGER) AS depth, NOT EXISTS (SELECT 1 FROM calls WHERE callee_id=x.id) AS is_entry FROM x JOIN m ON m.id=x.id", "depth, id", 20, f", {_ABOVE}"))(lambda s, d: R.top_with_more(G.impact(*_called(s, d)), ["depth", "id"], 20))
query("entry_callers", f"{_BASE}, {_ABOVE} SELECT x.id, m.full_name, CAST(x.depth AS INTEGER) AS depth FROM x JOIN m ON m.id=x.id WHERE depth>0 AND NOT EXISTS (SELECT 1 FROM calls WHERE callee_id=x.id)")(lambda s, d: G.entry_callers(*_called(s, d)))
query("impact_unknown", "SELECT '' AS id, '' AS full_name, 0 AS depth, true AS is_entry WHERE false")(lambda s, d: G.impact(graph(s, d), "no such method"))
query("coupling_top", _top_sql("SELECT grp, ca, ce FROM (" + _GROUPS.format(key="ns||'.'||tname").split(" SELECT grp, CAST(ca")[-1].join(["SELECT grp, CAST(ca", ""]) + ")", "ce DESC, grp", 5, ", " + _GROUPS.format(key="ns||'.'||tname").split(" SELECT grp, CAST(ca")[0]))(lambda s, d: R.top_with_more(R.coupling(graph(s, d), "type").select("grp", "ca", "ce"), [F.desc("ce"), "grp"], 5))
query("clone_pairs_top", f"WITH {_SEM}, r AS (SELECT a AS method_id_a, b AS method_id_b, round(s*0.5+0.5,4) AS score FROM sem), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, method_id_a, method_id_b) AS rk FROM r) SELECT method_id_a, method_id_b, score, CAST(rk AS INTEGER) AS rank, (SELECT count(*) FROM r) AS total, greatest(0, (SELECT count(*) FROM r)-10) AS more FROM ranked WHERE rk<=10")(lambda s, d: R.top_with_more(R.clone_pairs(graph(s, d).with_tables(clone_pairs=_pairs(s, d)), 0.1, "Semantic").select("method_id_a", "method_id_b", F.round(F.col("hybrid_score").cast("double"), 4).alias("score")), [F.desc("score"), "method_id_a", "method_id_b"], 10))
query("clusters_ordered", "WITH r AS (SELECT 'cluster-'||label AS id, 'label '||label AS label, CAST(count(*) AS INTEGER) AS member_count FROM embeddings WHERE label IS NOT NULL GROUP BY label) SELECT *, CAST(row_number() OVER (ORDER BY member_count DESC, id) AS INTEGER) AS rank, (SELECT count(*) FROM r) AS total, greatest(0, (SELECT count(*) FROM r)-100) AS more FROM r")(lambda s, d: R.top_with_more(graph(s, d).intent_clusters.select("id", "label", "member_count"), [F.desc("member_count"), "id"], 100))
query("dep_violations_top", f"{_VIO} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rule ORDER BY caller_id, callee_id) AS INTEGER) AS rank FROM hit) WHERE rank<=10")(lambda s, d: R.top_per_group(A.violations(graph(s, d), RULES).select("caller_id", "callee_id", "rule", "severity"), ["rule"], ["caller_id", "callee_id"], 10))
query("dep_check_summary", f"{_VIO} SELECT count(*) AS violations, count(*) FILTER (WHERE severity='Error') AS errors, count(*) FILTER (WHERE severity='Warning') AS warnings, (SELECT count(*) FROM calls WHERE caller_id IN (SELECT id FROM m)) AS calls_checked, 15 AS rules_applied FROM hit")(lambda s, d: A.check_summary(graph(s, d), T.parse_rules(json.dumps({"rules": RULES}), A.DEFAULT_RULES)))
query("zones_parsed", f"{_BASE} SELECT id, CASE WHEN ns='AMERICA.NATION_6' THEN 'DoNotModify' WHEN ns LIKE 'AMERICA.%' THEN 'RequireApproval' ELSE 'Deprecated' END AS level FROM m WHERE ns LIKE 'AMERICA.%' OR ns LIKE 'ASIA.%'")(lambda s, d: A.protected(graph(s, d).methods, T.parse_zones(json.dumps({"zones": ZONES}))).select("id", "level"))
query("layers_filtered", f"{_BASE} SELECT DISTINCT ns||'.'||tname AS type_id, 'Domain' AS layer, 1.0::DOUBLE AS confidence, 'Namespace pattern: EUROPE.*' AS reason, CAST(2 AS INTEGER) AS layer_rank FROM m WHERE ns LIKE 'EUROPE.%'")(lambda s, d: A.filter_layers(A.detect_layers(graph(s, d), LAYER_OF), "domain", 0.9))
query("churn_top", _top_sql("SELECT id, file_path, commits, CAST(commits*cc AS BIGINT) AS churn_score FROM m JOIN n USING (file_path) WHERE cc>0", "churn_score DESC, id", 20, f", {_COMMITS}, n AS (SELECT file_path, count(*) AS commits FROM c WHERE ts>=TIMESTAMP '2024-01-10' GROUP BY 1)"))(lambda s, d: R.top_with_more(R.churn(graph(s, d), _commits(s, d), "2024-01-10").select("id", "file_path", "commits", "churn_score"), [F.desc("churn_score"), "id"], 20))
_CHANGED = "lower(file_path) IN (SELECT lower('/src/'||replace(s_name,' ','_')||'.cs') FROM supplier WHERE s_acctbal>5000)"
query("diff_complex", f"{_BASE} SELECT id, full_name, file_path, cc AS cognitive_complexity FROM m WHERE {_CHANGED} AND cc>10 ORDER BY cc DESC, id LIMIT 10")(lambda s, d: R.diff_complex(R.diff(graph(s, d), _changed(s, d))))
query("diff_by_name", f"{_BASE} SELECT id, full_name, file_path, cc AS cognitive_complexity FROM m WHERE {_CHANGED}")(lambda s, d: R.diff(graph(s, d), _changed(s, d, "/elsewhere/")))


def _changed(spark: SparkSession, sf_dir: str, folder: str = "/src/") -> DataFrame:
    return read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit(folder), F.replace("s_name", F.lit(" "), F.lit("_")), F.lit(".cs")).alias("path"))


# names that decide: entry points, tests, tests of a method
_RENAMED = "CASE p_partkey%10 WHEN 0 THEN 'Main' WHEN 1 THEN 'Dispose' WHEN 2 THEN 'AddTest' WHEN 3 THEN '.ctor' ELSE name END"


def _renamed(spark: SparkSession, sf_dir: str) -> T.GraphTables:
    """The graph with every tenth method called Main, every tenth Dispose, and so on, and tests among suppliers."""
    t = graph(spark, sf_dir)
    k = F.col("id").cast("long") % 10
    name = F.when(k == 0, "Main").when(k == 1, "Dispose").when(k == 2, "AddTest").when(k == 3, ".ctor").otherwise(F.col("name"))
    full = F.when(k == 2, F.concat("full_name", F.lit("Test"))).otherwise(F.col("full_name"))
    types = t.types.withColumn("name", F.when(F.col("id").cast("long") % 3 == 0, F.concat("name", F.lit("Tests"))).otherwise(F.col("name")))
    return t.with_tables(methods=t.methods.withColumn("name", name).withColumn("full_name", full), types=types)


query("dead_code_names", f"{_BASE} SELECT id, full_name, file_path, start_line, cc AS cognitive_complexity FROM m WHERE p_partkey%10>3 AND CAST(type_id AS BIGINT)%3<>0 AND NOT EXISTS (SELECT 1 FROM calls WHERE callee_id=m.id)")(lambda s, d: R.dead_code(_renamed(s, d), True))
query("tests_of", f"{_BASE} SELECT id, full_name||'Test' AS full_name FROM m WHERE p_partkey%10=2 AND full_name ILIKE '%blue%'")(lambda s, d: A.tests_of(_renamed(s, d), "blue"))
query("cluster_of", "WITH q AS (SELECT label FROM embeddings WHERE vec_id=7) SELECT 'cluster-'||label AS cluster_id, 'label '||label AS label, 1.0::DOUBLE AS cohesion, CAST((SELECT count(*) FROM embeddings e WHERE e.label=q.label) AS INTEGER) AS member_count FROM q")(lambda s, d: R.cluster_of(graph(s, d), "7").withColumn("cohesion", F.col("cohesion").cast("double")))
query("export_edges", f"{_BASE}, k AS (SELECT id FROM m JOIN embeddings ON id=CAST(vec_id AS VARCHAR) WHERE 'label '||label ILIKE '%label 3%') SELECT caller_id, callee_id FROM calls WHERE caller_id IN (SELECT id FROM k) OR callee_id IN (SELECT id FROM k)")(lambda s, d: R.export_edges(graph(s, d), "label 3"))
query("export_counts", f"{_BASE}, k AS (SELECT id FROM m JOIN embeddings ON id=CAST(vec_id AS VARCHAR) WHERE 'label '||label ILIKE '%label 3%') SELECT (SELECT count(*) FROM k) AS method_count, count(*) AS relationship_count, 'label 3' AS concept FROM calls WHERE caller_id IN (SELECT id FROM k) OR callee_id IN (SELECT id FROM k)")(lambda s, d: R.export_counts(graph(s, d), "label 3"))


# stores
def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods saved, kept as the baseline, saved again without some; both read back."""
    root, t = scratch_path(spark, "store"), graph(spark, sf_dir)
    T.save(t, root)
    T.save_baseline(spark, root)
    kept = T.load(spark, root, "baseline")
    T.save(kept.with_tables(methods=kept.methods.where(F.col("id").cast("long") % 2 == 0)), root)
    read_ = lambda name: T.load(spark, root, name).methods.select(F.lit(name).alias("snapshot"), "id", "full_name", "start_line", "is_static", "accessibility")
    return read_("current").union(read_("baseline"))


_SCANNED = "id, full_name, start_line, p_partkey%3=0 AS is_static, accessibility FROM m"
query("store_roundtrip", f"{_BASE} SELECT 'baseline' AS snapshot, {_SCANNED} UNION ALL SELECT 'current', {_SCANNED} WHERE p_partkey%2=0")(_stored)
query("upsert_metadata", "SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey%3=0 THEN 'new' ELSE n_name END AS value FROM nation UNION ALL SELECT 'added', 'new'")(lambda s, d: _metadata(s, d))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    new = old.where("cast(key as int) % 3 = 0").select("key", F.lit("new").alias("value")).union(spark.createDataFrame([("added", "new")], "key string, value string"))
    return T.upsert_metadata(old, new)


# scalar functions
query("tokenize_lower", f"{_BASE} SELECT id, lower(array_to_string(regexp_extract_all(name, '([A-Z]+[a-z]*|[a-z]+|[0-9]+)'), ' ')) AS tokens FROM m")(lambda s, d: graph(s, d).methods.select("id", F.array_join(N.tokenize_lower(F.col("name")), " ").alias("tokens")))
query("pascal_split", "SELECT p_partkey, array_to_string(regexp_extract_all(p_type||'x'||p_brand, '^[^A-Z]+|[A-Z][^A-Z]*'), '|') AS parts FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(N.pascal_split(F.concat("p_type", F.lit("x"), "p_brand")), "|").alias("parts")))
query("collapsed_signature", r"SELECT doc_id, md5(trim(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g'))) AS signature FROM documents")(lambda s, d: read(s, d, "documents").select("doc_id", F.md5(N.collapse_space(F.col("text"))).alias("signature")))
query("clean_types", "SELECT p_partkey, regexp_extract(p_brand, '[^#]*')||'#'||regexp_extract(p_brand, '[0-9]+') AS a, replace(p_name,' ','') AS b FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", N.clean_type(F.concat(F.lit("Some.Place."), "p_brand", F.lit("<List<int>, Other.Kind>[]?"))).alias("a"), N.clean_type(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("[]"))).alias("b")))
query(
    "semantic_payload",
    "WITH l AS (SELECT p_partkey, list_concat(list_concat(list_concat(string_split(p_name,' '), ['get']), [lower(regexp_extract(p_brand,'[A-Za-z]+')), regexp_extract(p_brand,'[0-9]+')]), list_concat([lower(p_type)], list_concat(list_concat(['call'], string_split(p_name,' ')), list_concat(['one','two','33'], list_filter(string_split(p_name,' '), lambda x: len(x)>1))))) AS l FROM part) SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x)=i), ' ') AS payload FROM l",
)(lambda s, d: read(s, d, "part").select("p_partkey", N.semantic_payload(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("Get")), F.array(F.concat(F.lit("My.Space."), "p_brand", F.lit("[]"))), F.col("p_type"), F.array(F.concat(F.lit("Call_"), F.replace("p_name", F.lit(" "), F.lit("_")))), F.array(F.lit("one, Two a 33!"), F.col("p_name"), F.repeat(F.lit("long "), 30))).alias("payload")))
query("age_buckets", "SELECT event_id, CASE WHEN n<1 THEN 'today' WHEN n<2 THEN '1d' WHEN n<30 THEN n||'d' WHEN n<365 THEN (n//30)||'mo' ELSE (n//365)||'y' END AS age FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE) - CAST(event_id%700 AS INTEGER), DATE '2024-01-31') AS n FROM events)")(lambda s, d: read(s, d, "events").select("event_id", N.age_bucket(F.expr("date_sub(to_date(ts), cast(event_id % 700 as int))"), F.lit("2024-01-31").cast("date")).alias("age")))
query("tags", f"{_BASE} SELECT id, lower(kind) AS kind_tag, CASE accessibility WHEN 'Public' THEN '+' ELSE '-' END AS visibility FROM m")(lambda s, d: (t := graph(s, d)).methods.join(t.types.select(F.col("id").alias("type_id"), "kind"), "type_id").select("id", N.kind_tag(F.col("kind")).alias("kind_tag"), N.visibility_tag(F.col("accessibility")).alias("visibility")))
query("csv_and_rounding", "SELECT doc_id, md5(CASE WHEN regexp_matches(t, '[,\"\n\r]') THEN '\"'||replace(t,'\"','\"\"')||'\"' ELSE t END) AS field, round_even(doc_id/32.0::DOUBLE, 4) AS rounded FROM (SELECT doc_id, coalesce(text,'') AS t FROM documents)")(lambda s, d: read(s, d, "documents").select("doc_id", F.md5(N.csv_column(F.col("text"))).alias("field"), F.bround(F.col("doc_id") / 32, 4).alias("rounded")))
_STALE = [("never", None, None, None, None, None), ("commit", "2024-01-01", "a", "b", None, None), ("sources", "2024-01-01", "a", "a", "2024-01-02", None), ("solution", "2024-01-01", "a", "a", "2023-12-31", "2024-01-03"), ("old", "2024-01-01", None, "b", None, None), ("fresh", "2024-01-30", "a", "a", "2024-01-29", "2024-01-28")]
query("staleness", "SELECT * FROM (VALUES ('never',true,'high','never analyzed'),('commit',true,'high','commit differs'),('sources',true,'medium','sources are newer'),('solution',true,'medium','solution is newer'),('old',true,'low','older than a week'),('fresh',false,'none','current')) v(name, stale, level, reason)")(lambda s, d: _staleness(s))


def _staleness(spark: SparkSession) -> DataFrame:
    out = []
    for name, at, commit, head, newest, solution in _STALE:
        rows = [(k, v) for k, v in (("analyzed_at", at), ("commit", commit)) if v]
        out.append(R.staleness(spark, spark.createDataFrame(rows, "key string, value string"), head, newest, "2024-01-31", solution).withColumn("name", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


_BAD = Q.GraphQuery(Q.Seed(), Q.Expand("sideways", 101), Q.Filter(includeNamespaces=("A", "b"), excludeNamespaces=("B",), excludeTypes=(" ",), minComplexity=-1), Q.Rank("best"), Q.Output(0))
query("query_errors", "SELECT * FROM (VALUES ('seed'),('expand.direction'),('expand.maxDepth'),('filter.minComplexity'),('filter'),('filter.excludeTypes'),('rank.strategy'),('output.maxResults')) v(place)")(lambda s, d: s.createDataFrame([(e.split(":")[0],) for e in Q.validate(_BAD)], "place string"))
