"""Command line over stored snapshots."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callatlas.operators import architecture, drift, embedding, graph, relational, similarity
from callatlas.operators.context import build, context
from callatlas.plans.graph_query import Expand, GraphQuery, Output, Rank, Seed, execute, json_schema
from callatlas.render import FORMATS, render
from callatlas.sources import csharp, git
from callatlas.sources import tables as T

#: Names of ranking strategies on the command line.
STRATEGIES = {"blast-radius": "blastRadius", "complexity": "complexity", "coupling": "coupling", "combined": "combined"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="callatlas")
    p.add_argument("--root", required=True, help="folder of the snapshots")
    p.add_argument("--snapshot", default="current")
    p.add_argument("--format", choices=FORMATS, default="compact")
    p.add_argument("--top", type=int, default=20)
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser
    h = add("hotspots")
    h.add_argument("--by", choices=("complexity", "blast", "risk"), default="complexity")
    h.add_argument("--threshold", type=int)
    for name in ("impact", "callgraph", "context", "similar", "duplicates-of"):
        c = add(name)
        c.add_argument("method")
        c.add_argument("--depth", type=int)
        c.add_argument("--direction", choices=graph.DIRECTIONS, default="both")
    add("search").add_argument("pattern")
    add("dead-code").add_argument("--include-overrides", action="store_true")
    add("coupling").add_argument("--level", choices=("namespace", "type"), default="namespace")
    d = add("duplicates")
    d.add_argument("--threshold", type=float, default=0.0)
    d.add_argument("--type")
    d.add_argument("--concept")
    t = add("tree")
    t.add_argument("--namespace")
    t.add_argument("--type")
    t.add_argument("--include-private", action="store_true")
    add("export").add_argument("--concept")
    y = add("layers")
    y.add_argument("--layer")
    y.add_argument("--min-confidence", type=float, default=0.0)
    add("check-deps").add_argument("--rules")
    add("protected").add_argument("--zones", required=True)
    for name in ("token-search", "semantic-search"):
        add(name).add_argument("query")
    q = add("query")
    q.add_argument("document", nargs="?", help="JSON of a graph query")
    q.add_argument("--query-file")
    q.add_argument("--seed")
    q.add_argument("--depth", type=int, default=3)
    q.add_argument("--direction", default="both")
    q.add_argument("--rank", choices=sorted(STRATEGIES), default="blast-radius")
    q.add_argument("--schema", action="store_true")
    z = add("analyze")
    z.add_argument("sources", help="folder of the source files")
    z.add_argument("--save-baseline", action="store_true")
    z.add_argument("--no-clusters", action="store_true")
    u = add("churn")
    u.add_argument("repository")
    u.add_argument("--since", default="6 months ago")
    f = add("diff")
    f.add_argument("repository")
    f.add_argument("--from", dest="old", default="HEAD~1")
    f.add_argument("--to", dest="new", default="HEAD")
    f.add_argument("--complex", action="store_true", help="only the most complex of them")
    add("serve")
    for name in ("clusters", "drift", "blast-radius", "status", "save-baseline"):
        add(name)
    return p


def query_of(document: str | None, path: str | None, seed: str | None, depth: int = 3, direction: str = "both", rank: str = "blast-radius", top: int = 20) -> GraphQuery:
    """A graph query from a file, else from JSON, else from quick options."""
    if path:
        with open(path, encoding="utf-8") as f:
            return GraphQuery.from_json(f.read())
    if document:
        return GraphQuery.from_json(document)
    if not seed or not seed.strip():
        raise ValueError("one of a document, --query-file and --seed is needed")
    named = Seed(methodId=seed) if "(" in seed and not set("*?") & set(seed) else Seed(methodPattern=seed)
    return GraphQuery(named, Expand(direction, depth, direction != "none"), None, Rank(STRATEGIES[rank]), Output(top))


def analyze(spark: SparkSession, root: str, sources: str, baseline: bool = False, clusters: bool = True) -> DataFrame:
    """Read source files, build everything derived, store it as the current snapshot; a summary with the errors."""
    t, _, errors = csharp.ingest(spark, csharp.read_sources(spark, sources), sources.rstrip("/").split("/")[-1], sources)
    t = build(t, clusters)
    stamp = [(k, v) for k, v in (("analyzed_at", datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")), ("commit", git.head(sources))) if v]
    T.save(t.with_tables(metadata=T.upsert_metadata(t.metadata, spark.createDataFrame(stamp, "key string, value string"))), root)
    if baseline:
        T.save_baseline(spark, root)
    return relational.summary(T.load(spark, root)).crossJoin(errors.agg(F.count("*").alias("n_errors")))  # one row each


def method_id(t: T.GraphTables, name: str) -> str:
    rows = relational.resolve_method(t, name).limit(2).collect()
    if not rows:
        raise SystemExit(f"no method {name}")
    if not rows[0].unique:
        raise SystemExit(f"several methods match {name}: {rows[0].full_name}, {rows[1].full_name} ...")
    return rows[0].id


def named(t: T.GraphTables, found: DataFrame) -> DataFrame:
    """Found methods with their full names where these are known."""
    return found.join(t.methods.select(F.col("id").alias("method_id"), "full_name"), "method_id", "left")


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    if a.command == "analyze":
        return analyze(spark, a.root, a.sources, a.save_baseline, not a.no_clusters)
    t = T.load(spark, a.root, a.snapshot)
    one = lambda: method_id(t, a.method)
    match a.command:
        case "hotspots":
            return relational.hotspots(t, a.top, a.threshold, a.by)
        case "impact":
            return graph.impact(t, one(), a.depth).orderBy("depth", "id")
        case "callgraph":
            return graph.callgraph(t, one(), a.depth or 2, a.direction)[1]
        case "context":
            return context(t, one())
        case "similar":
            return similarity.similar(t.embeddings, one(), a.top)
        case "duplicates-of":
            return relational.duplicates_of(t, one()).orderBy(F.desc("hybrid_score"), "other_id")
        case "search":
            return relational.search_methods(t, a.pattern).orderBy("id")
        case "dead-code":
            return relational.dead_code(t, a.include_overrides).orderBy(F.desc("cognitive_complexity"), "id")
        case "coupling":
            return relational.coupling(t, a.level).orderBy(F.desc("ce"), "grp")
        case "duplicates":
            return relational.clone_pairs(t, a.threshold, a.type, a.concept).orderBy(F.desc("hybrid_score"), "method_id_a")
        case "tree":
            return relational.tree_top(relational.tree(t, a.namespace, a.type, a.include_private)).orderBy("project", "namespace", "type")
        case "export":
            return relational.export_methods(t, a.concept)
        case "layers":
            stored = t.type_layers if not t.type_layers.isEmpty() else architecture.refine_layers(t, architecture.detect_layers(t))
            return architecture.filter_layers(stored, a.layer, a.min_confidence).orderBy("layer_rank", F.desc("confidence"), "type_id")
        case "check-deps":
            rules = T.read_rules(a.rules, architecture.DEFAULT_RULES) if a.rules else None
            return architecture.violation_counts(architecture.violations(t, rules)).orderBy(F.desc("n"), "rule")
        case "protected":
            return architecture.protected(t.methods, T.read_zones(a.zones)).orderBy("id")
        case "token-search":
            cells = similarity.hash_embedding(t.normalized_methods, "method_id", "semantic_payload")
            return similarity.search_tokens(spark, cells, a.query, a.top)
        case "query":
            return execute(t, query_of(a.document, a.query_file, a.seed, a.depth, a.direction, a.rank, a.top))
        case "semantic-search":
            return named(t, embedding.semantic_search(spark, t.embeddings, a.query, k=a.top)).orderBy(F.desc("score"), "method_id")
        case "churn":
            return relational.churn(t, git.commits(spark, a.repository, a.since)).orderBy(F.desc("churn_score"), "id")
        case "diff":
            found = relational.diff(t, git.changed_files(spark, a.repository, a.old, a.new))
            return relational.diff_complex(found) if a.complex else found.orderBy("id")
        case "clusters":
            return t.intent_clusters.orderBy(F.desc("member_count"), "id")
        case "drift":
            return drift.report(t, T.load(spark, a.root, "baseline")).orderBy("section", "key")
        case "blast-radius":
            return graph.blast_radius(t).orderBy(F.desc("transitive_callers"), "id")
        case "status":
            return relational.summary(t)
        case "save-baseline":
            T.save_baseline(spark, a.root)
    return None


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "query" and a.schema:
        print(json.dumps(json_schema(), indent=2))
        return 0
    spark = SparkSession.builder.appName("callatlas").getOrCreate()
    if a.command == "serve":
        from callatlas.server import serve

        serve(spark, a.root, sys.stdin, sys.stdout)
        return 0
    out = run(spark, a)
    if out is not None:
        print(render(out, a.format, a.top))
    return int(a.command == "drift" and out is not None and not out.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
