"""Declarative graph queries: seed, expand, filter, rank, output as a JSON document."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from dataclasses import asdict, dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callatlas.functions.text import contains, glob
from callatlas.operators.graph import bfs_by_seed, scanned_edges
from callatlas.operators.relational import degrees
from callatlas.sources.scratch import materialize
from callatlas.sources.tables import GraphTables

DIRECTIONS = ("callees", "callers", "both", "none")
STRATEGIES = ("blastRadius", "complexity", "coupling", "combined")
MAX_PATTERN, MAX_DEPTH, MAX_RESULTS = 500, 100, 1000


@dataclass(frozen=True)
class Seed:
    methodId: str | None = None
    methodPattern: str | None = None
    namespace: str | None = None
    cluster: str | None = None


@dataclass(frozen=True)
class Expand:
    direction: str = "both"
    maxDepth: int = 3
    includeTransitive: bool = True


@dataclass(frozen=True)
class Filter:
    includeNamespaces: tuple[str, ...] = ()
    excludeNamespaces: tuple[str, ...] = ()
    includeTypes: tuple[str, ...] = ()
    excludeTypes: tuple[str, ...] = ()
    includeAccessibility: tuple[str, ...] = ()
    minComplexity: int | None = None
    maxComplexity: int | None = None
    excludeTests: bool = False
    excludeGenerated: bool = True


@dataclass(frozen=True)
class Rank:
    strategy: str = "blastRadius"
    descending: bool = True


@dataclass(frozen=True)
class Output:
    maxResults: int = 20
    format: str = "compact"
    includeMetrics: bool = True
    includeLocation: bool = True


@dataclass(frozen=True)
class GraphQuery:
    seed: Seed = field(default_factory=Seed)
    expand: Expand = field(default_factory=Expand)
    filter: Filter | None = None
    rank: Rank = field(default_factory=Rank)
    output: Output = field(default_factory=Output)

    @staticmethod
    def from_json(text: str) -> GraphQuery:
        doc = json.loads(text)
        if not isinstance(doc, dict):
            raise ValueError("a query is a JSON object")
        made = {}
        for name, kind in (("seed", Seed), ("expand", Expand), ("filter", Filter), ("rank", Rank), ("output", Output)):
            part = doc.get(name)
            if part is not None:
                known = {f.name for f in fields(kind)}
                made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in part.items() if k in known})
        return GraphQuery(**made)

    def to_json(self) -> str:
        drop = lambda d: {k: drop(v) if isinstance(v, dict) else list(v) if isinstance(v, tuple) else v for k, v in d.items() if v is not None and v != ()}
        return json.dumps(drop(asdict(self)))

    def key(self) -> str:
        """Hash of everything but the output options."""
        doc = {k: v for k, v in asdict(self).items() if k != "output"}
        return hashlib.sha256(json.dumps(doc, sort_keys=True).encode()).hexdigest().upper()


def json_schema() -> dict:
    """A JSON Schema of query documents."""
    kinds = {"str": "string", "int": "integer", "bool": "boolean", "tuple": "array"}
    one = lambda k: {"type": "object", "properties": {f.name: {"type": next(v for n, v in kinds.items() if str(f.type).startswith(n))} for f in fields(k)}}
    return {"type": "object", "required": ["seed"], "properties": {"seed": one(Seed), "expand": one(Expand), "filter": one(Filter), "rank": one(Rank), "output": one(Output)}}


def validate(q: GraphQuery) -> list[str]:
    """All errors of a query."""
    errors = []
    given = [v for v in asdict(q.seed).values() if v is not None]
    if not given:
        errors.append("seed: one of methodId, methodPattern, namespace, cluster is needed")
    errors += [f"seed.{k}: is blank" for k, v in asdict(q.seed).items() if v is not None and not v.strip()]
    if q.seed.methodPattern and len(q.seed.methodPattern) > MAX_PATTERN:
        errors.append(f"seed.methodPattern: longer than {MAX_PATTERN}")
    if q.expand.direction not in DIRECTIONS:
        errors.append(f"expand.direction: one of {', '.join(DIRECTIONS)}")
    if not 0 <= q.expand.maxDepth <= MAX_DEPTH:
        errors.append(f"expand.maxDepth: from 0 to {MAX_DEPTH}")
    if q.expand.direction == "none" and q.expand.includeTransitive:
        errors.append("expand: direction none needs includeTransitive false")
    if q.filter:
        f = q.filter
        errors += [f"filter.{k}: is below 0" for k in ("minComplexity", "maxComplexity") if (getattr(f, k) or 0) < 0]
        if f.minComplexity is not None and f.maxComplexity is not None and f.minComplexity > f.maxComplexity:
            errors.append("filter: minComplexity is over maxComplexity")
        both = {x.lower() for x in f.includeNamespaces} & {x.lower() for x in f.excludeNamespaces}
        if both:
            errors.append(f"filter: included and excluded: {', '.join(sorted(both))}")
        for name in ("includeNamespaces", "excludeNamespaces", "includeTypes", "excludeTypes", "includeAccessibility"):
            if any(not x.strip() for x in getattr(f, name)):
                errors.append(f"filter.{name}: has a blank entry")
    if q.rank.strategy not in STRATEGIES:
        errors.append(f"rank.strategy: one of {', '.join(STRATEGIES)}")
    if not 1 <= q.output.maxResults <= MAX_RESULTS:
        errors.append(f"output.maxResults: from 1 to {MAX_RESULTS}")
    return errors


class PlanCache:
    """Resolved seeds by query key: least recently used go first, all go after `ttl` seconds."""

    def __init__(self, size: int = 100, ttl: float = 300.0, clock=time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.held: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str):
        found = self.held.get(key)
        if found is None or self.clock() - found[0] > self.ttl:
            self.held.pop(key, None)
            self.misses += 1
            return None
        self.held.move_to_end(key)
        self.hits += 1
        return found[1]

    def put(self, key: str, value: object) -> None:
        self.held[key] = (self.clock(), value)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)

    def clear(self) -> None:
        self.held.clear()


def seeds(t: GraphTables, s: Seed) -> DataFrame:
    """id and seq of what a seed names, in the order by id, pattern (stars dropped, ? any one character, anywhere in
    the name), namespace (anywhere in the name) and the largest cluster whose label contains the text; each id once, at
    its first place. Places within a part go by id; they are numbered without gathering the ids."""
    parts = []
    if s.methodId:
        parts.append(t.methods.where(F.col("id") == s.methodId).select("id"))
    if s.methodPattern:
        parts.append(t.methods.where(contains("full_name", s.methodPattern.replace("*", "").replace("?", "_"))).select("id"))
    if s.namespace:
        parts.append(t.methods.where(contains("full_name", s.namespace)).select("id"))
    if s.cluster:
        best = t.intent_clusters.where(contains("label", s.cluster)).orderBy(F.desc("member_count"), "id").limit(1)
        parts.append(t.method_cluster_map.join(F.broadcast(best.select(F.col("id").alias("cluster_id"))), "cluster_id").select(F.col("method_id").alias("id")))  # one row
    if not parts:
        return t.methods.select("id", F.lit(0).cast("long").alias("seq")).limit(0)
    named = reduce(DataFrame.union, [p.select("id", F.lit(k).alias("part")) for k, p in enumerate(parts)]).groupBy("id").agg(F.min("part").alias("part"))
    return named.orderBy("part", "id").select("id", F.monotonically_increasing_id().alias("seq"))


def _matches(column: Column, entry: str) -> Column:
    return glob(column, entry) if "*" in entry or "?" in entry else F.contains(F.lower(column), F.lit(entry.lower()))


def filter_condition(f: Filter | None) -> Column:
    """Include and exclude lists against the full name, accessibility where it is known, complexity bounds, tests by
    their names, generated code by its."""
    if f is None:
        return F.lit(True)
    full = F.col("full_name")
    any_of = lambda es: reduce(lambda a, b: a | b, [_matches(full, e) for e in es])
    terms = [F.lit(True)]
    terms += [any_of(es) for es in (f.includeNamespaces, f.includeTypes) if es]
    terms += [~any_of(es) for es in (f.excludeNamespaces, f.excludeTypes) if es]
    if f.includeAccessibility:
        terms.append(F.col("accessibility").isNull() | F.lower("accessibility").isin(*[a.lower() for a in f.includeAccessibility]))
    cc = F.coalesce("complexity", F.lit(0))
    if f.minComplexity is not None:
        terms.append(cc >= f.minComplexity)
    if f.maxComplexity is not None:
        terms.append(cc <= f.maxComplexity)
    if f.excludeTests:
        terms.append(~contains("full_name", "Test"))
    if f.excludeGenerated:
        terms.append(~(full.contains(".g.") | full.contains("<") | full.contains("GeneratedCode")))
    return reduce(lambda a, b: a & b, terms)


@dataclass(frozen=True)
class Result:
    """Ranked rows of a query, the edges between the nodes that the filter left, and how many nodes were reached."""

    nodes: DataFrame
    edges: DataFrame
    reached: DataFrame

    def total_matches(self) -> int:
        """Nodes reached, before filter and limit."""
        return self.reached.count()


def run(t: GraphTables, q: GraphQuery, cache: PlanCache | None = None) -> Result:
    """Execute a query; its errors are raised.

    Filters come after the walk: what they drop still conducts, and seeds always stay. A node that several seeds reach
    has the depth from the first of them (by id, then in the order of the seed's parts). Ranking uses stored metrics:
    blast radius, complexity, degree, or complexity times 1 + ln(1 + blast radius); a single row has no score."""
    errors = validate(q)
    if errors:
        raise ValueError("; ".join(errors))
    start = cache.get(q.key()) if cache else None
    if start is None:
        start = seeds(t, q.seed)
        if cache:
            cache.put(q.key(), start)
    depth = max(1, q.expand.maxDepth) if q.expand.includeTransitive else 1
    if q.expand.direction == "none":
        reached = start.select("id", F.lit(0).alias("depth"))
    else:
        reached = materialize(bfs_by_seed(t.method_calls, start, q.expand.direction, depth).select("id", "depth"), "reached")
    m = t.metrics.select(F.col("method_id").alias("id"), F.col("cognitive_complexity").alias("complexity"), "blast_radius", F.col("lines_of_code").alias("loc"), F.col("nesting_depth").alias("nesting"))
    known = reached.join(t.methods.select("id", "full_name", "file_path", F.col("start_line").alias("line"), "accessibility"), "id").join(m, "id", "left")
    rows = known.where((F.col("depth") == 0) | filter_condition(q.filter))
    if q.expand.direction == "none":
        edges = t.method_calls.select(F.col("caller_id").alias("from_id"), F.col("callee_id").alias("to_id"), F.lit("").alias("direction")).limit(0)
    else:
        gone = known.join(rows.select("id"), "id", "left_anti").select("id")
        edges = scanned_edges(t.method_calls, reached, q.expand.direction, depth)
        edges = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("from_id", "to_id", "direction")
    if q.rank.strategy == "coupling":
        rows = rows.join(degrees(t), "id", "left")
    cc, br = F.coalesce("complexity", F.lit(0)), F.coalesce("blast_radius", F.lit(0))
    deg = F.coalesce("afferent", F.lit(0)) + F.coalesce("efferent", F.lit(0)) if q.rank.strategy == "coupling" else F.lit(0)
    score = {"blastRadius": br.cast("double"), "complexity": cc.cast("double"), "coupling": deg.cast("double"), "combined": cc * (1 + F.log1p(br))}[q.rank.strategy]
    n = rows.agg(F.count("*").alias("n"))
    rows = rows.crossJoin(F.broadcast(n))  # one row
    shown = ["id", "full_name", "depth", cc.alias("complexity"), br.alias("blast_radius"), F.when(F.col("n") > 1, F.round(score, 6)).alias("rank_score")]
    if q.output.includeMetrics:
        shown += ["loc", "nesting"]
    if q.output.includeLocation:
        shown += ["file_path", "line"]
    rows = rows.select(*shown)
    order = F.desc("rank_score") if q.rank.descending else F.asc("rank_score")
    return Result(rows.orderBy(order, "id").limit(q.output.maxResults), edges, reached)


def execute(t: GraphTables, q: GraphQuery, cache: PlanCache | None = None) -> DataFrame:
    """The ranked rows of run()."""
    return run(t, q, cache).nodes
