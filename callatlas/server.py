"""Tools over a store for agents: JSON-RPC, a message a line."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callatlas import cli
from callatlas.operators import drift, graph, relational, similarity
from callatlas.operators.context import context
from callatlas.operators.embedding import IndexCache, semantic_search
from callatlas.plans.graph_query import Filter, PlanCache, run
from callatlas.render import render
from callatlas.sources import git
from callatlas.sources import tables as T

#: Fixed value: the protocol's version.
PROTOCOL = "2024-11-05"
#: Depths that the query tool takes.
LEAST_DEPTH, MOST_DEPTH = 1, 10

#: Tools, what they are for, and their arguments: name, type, default (... marks one that must be given).
TOOLS: dict[str, tuple[str, list[tuple[str, str, Any]]]] = {
    "cg_analyze": ("Read source files and build the store", [("solution", "string", None), ("save_baseline", "boolean", False)]),
    "cg_churn": ("Methods that change often and are complex", [("since", "string", "6 months ago"), ("top", "integer", 20)]),
    "cg_coupling": ("Calls between groups, their instability and abstractness", [("level", "string", "namespace"), ("top", "integer", 20)]),
    "cg_diff": ("Methods in files that differ between two revisions", [("from", "string", "HEAD~1"), ("to", "string", "HEAD"), ("format", "string", "summary")]),
    "cg_get_drift": ("What has drifted from the baseline", [("baseline", "string", None)]),
    "cg_query": ("Methods by a graph query", [("seed", "string", ...), ("expand", "string", "both"), ("depth", "integer", 3), ("rank", "string", "blast-radius"), ("top", "integer", 20), ("exclude_tests", "boolean", True)]),
    "cg_get_hotspots": ("The most complex methods", [("top", "integer", 10), ("threshold", "integer", None)]),
    "cg_get_callgraph": ("Callers and callees of a method", [("method", "string", ...), ("depth", "integer", 2), ("direction", "string", "both")]),
    "cg_get_tree": ("Projects, namespaces, types and methods", [("namespace", "string", None), ("type", "string", None), ("include_private", "boolean", False)]),
    "cg_dead_code": ("Methods that nothing calls", [("top", "integer", 20), ("include_overrides", "boolean", False)]),
    "cg_get_impact": ("Everything that calls a method, directly or not", [("method", "string", ...), ("depth", "integer", None)]),
    "cg_token_search": ("Methods by the words of their names", [("query", "string", ...), ("top", "integer", 5)]),
    "cg_semantic_search": ("Methods by meaning", [("query", "string", ...), ("top", "integer", 10)]),
    "cg_get_similar": ("Methods similar to one", [("method", "string", ...), ("top", "integer", 10)]),
    "cg_get_duplicates": ("Code clones, of one method or of all", [("method", "string", None), ("top", "integer", 10)]),
    "cg_get_clusters": ("Groups of methods with a like purpose", []),
    "cg_export_graph": ("Methods, calls and metrics as JSON", [("concept", "string", None)]),
    "cg_get_context": ("Everything known about a method", [("method", "string", ...)]),
}


def definitions() -> list[dict]:
    out = []
    for name, (why, given) in TOOLS.items():
        properties = {n: {"type": kind} | ({} if default in (None, ...) else {"default": default}) for n, kind, default in given}
        needed = [n for n, _, default in given if default is ...]
        out.append({"name": name, "description": why, "inputSchema": {"type": "object", "properties": properties} | ({"required": needed} if needed else {})})
    return out


class Tools:
    """The tools over one store. Methods are named by id or by any part of their full name: the first match counts."""

    def __init__(self, spark: SparkSession, root: str, repository: str = "."):
        self.spark, self.root, self.repository = spark, root, repository
        self.plans, self.indexes = PlanCache(), IndexCache()

    def call(self, name: str, arguments: dict) -> str:
        if name not in TOOLS:
            raise ValueError(f"unknown tool {name}")
        args = {n: arguments.get(n, None if default is ... else default) for n, _, default in TOOLS[name][1]}
        lacking = [n for n, _, default in TOOLS[name][1] if default is ... and args[n] in (None, "")]
        if lacking:
            raise ValueError(f"{', '.join(lacking)}: needed")
        if name == "cg_analyze":
            out = cli.analyze(self.spark, self.root, args["solution"] or self.repository, args["save_baseline"])
            self.indexes.drop(self.root)
            self.plans.clear()
            return render(out, "compact", 1)
        made = getattr(self, name.removeprefix("cg_").removeprefix("get_"))(T.load(self.spark, self.root), args)
        return made if isinstance(made, str) else render(made, "compact", args.get("top") or 100)

    def method(self, t: T.GraphTables, name: str) -> str:
        found = t.methods.where(F.col("id") == name).select("id").first() or relational.search_methods(t, name).orderBy("id").first()
        if found is None:
            raise ValueError(f"no method {name}")
        return found.id

    def churn(self, t: T.GraphTables, a: dict) -> DataFrame:
        return relational.churn(t, git.commits(self.spark, self.repository, a["since"])).orderBy(F.desc("churn_score"), "id")

    def coupling(self, t: T.GraphTables, a: dict) -> DataFrame:
        return relational.coupling(t, a["level"]).orderBy(F.desc("ce"), "grp")

    def diff(self, t: T.GraphTables, a: dict) -> DataFrame | str:
        found = relational.diff(t, git.changed_files(self.spark, self.repository, a["from"], a["to"])).orderBy("id")
        return render(relational.diff_complex(found), "compact", 10) if a["format"] == "summary" else render(found, "json" if a["format"] == "json" else "compact")

    def drift(self, t: T.GraphTables, a: dict) -> DataFrame:
        return drift.report(t, T.load(self.spark, self.root, a["baseline"] or "baseline")).orderBy("section", "key")

    def query(self, t: T.GraphTables, a: dict) -> DataFrame:
        q = cli.query_of(None, None, a["seed"], min(MOST_DEPTH, max(LEAST_DEPTH, a["depth"])), a["expand"], a["rank"], a["top"])
        object.__setattr__(q, "filter", Filter(excludeTests=a["exclude_tests"]))
        return run(t, q, self.plans).nodes

    def hotspots(self, t: T.GraphTables, a: dict) -> DataFrame:
        return relational.hotspots(t, a["top"], a["threshold"])

    def callgraph(self, t: T.GraphTables, a: dict) -> DataFrame:
        return graph.callgraph(t, self.method(t, a["method"]), a["depth"], a["direction"])[1].distinct().orderBy("caller_id", "callee_id")

    def tree(self, t: T.GraphTables, a: dict) -> DataFrame:
        return relational.ordered_tree(relational.tree(t, a["namespace"], a["type"], a["include_private"]))

    def dead_code(self, t: T.GraphTables, a: dict) -> DataFrame:
        return relational.dead_code(t, a["include_overrides"]).orderBy(F.desc("cognitive_complexity"), "id")

    def impact(self, t: T.GraphTables, a: dict) -> DataFrame:
        return graph.impact(t, self.method(t, a["method"]), a["depth"]).orderBy("depth", "id")

    def token_search(self, t: T.GraphTables, a: dict) -> DataFrame:
        cells = similarity.hash_embedding(t.normalized_methods, "method_id", "semantic_payload")
        return similarity.search_tokens(self.spark, cells, a["query"], a["top"])

    def semantic_search(self, t: T.GraphTables, a: dict) -> DataFrame:
        index = self.indexes.get(self.root, lambda: t.embeddings)
        return cli.named(t, semantic_search(self.spark, index.vectors, a["query"], k=a["top"])).orderBy(F.desc("score"), "method_id")

    def similar(self, t: T.GraphTables, a: dict) -> DataFrame:
        index = self.indexes.get(self.root, lambda: t.embeddings)
        return cli.named(t, similarity.similar(index.vectors, self.method(t, a["method"]), a["top"])).orderBy(F.desc("score"), "method_id")

    def duplicates(self, t: T.GraphTables, a: dict) -> DataFrame:
        found = relational.duplicates_of(t, self.method(t, a["method"])) if a["method"] else relational.clone_pairs(t)
        return found.orderBy(F.desc("hybrid_score"), found.columns[0])

    def clusters(self, t: T.GraphTables, a: dict) -> DataFrame:
        return t.intent_clusters.orderBy(F.desc("member_count"), "id")

    def export_graph(self, t: T.GraphTables, a: dict) -> str:
        part = lambda df, *by: json.loads(render(df.orderBy(*by), "json", 10_000))
        counts = relational.export_counts(t, a["concept"]).first().asDict()
        return json.dumps({"methods": part(relational.export_methods(t, a["concept"]), "id"), "relationships": part(relational.export_edges(t, a["concept"]), "caller_id", "callee_id"), "metadata": counts})

    def context(self, t: T.GraphTables, a: dict) -> str:
        return render(context(t, self.method(t, a["method"])), "json", 1)


def answer(message: dict, call: Callable[[str, dict], str]) -> dict | None:
    """The reply to a message; none to a notification."""
    method, id_ = message.get("method"), message.get("id")
    reply = {"jsonrpc": "2.0", "id": id_}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "callatlas", "version": "0.1.0"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": definitions()}}
    if method == "tools/call":
        params = message.get("params") or {}
        try:
            text, bad = call(params.get("name", ""), params.get("arguments") or {}), False
        except Exception as e:  # whatever a tool fails of is its answer
            text, bad = f"Error: {e}", True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": bad}}
    return None if id_ is None else reply | {"error": {"code": -32601, "message": f"Method not found: {method}"}}


def serve(spark: SparkSession, root: str, lines: TextIO, out: TextIO, repository: str = ".") -> None:
    """Answer messages until the input ends."""
    tools = Tools(spark, root, repository)
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(json.loads(line), tools.call)
        except (ValueError, AttributeError) as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32603, "message": f"Internal error: {e}"}}
        if reply is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()
