"""Architectural layers, dependency rules and protected zones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callatlas.functions.text import contains, glob, group_key
from callatlas.operators.relational import tree
from callatlas.schema import LAYERS
from callatlas.sources.tables import GraphTables

#: Namespace patterns of the layers, in order of precedence.
LAYER_PATTERNS: dict[str, list[str]] = {
    "Presentation": ["*.Controllers.*", "*.Controllers", "*.Api.*", "*.Api", "*.Web.*", "*.ViewModels.*", "*.Views.*", "*.Blazor.*", "*.Mvc.*", "*.WebApi.*", "*.Endpoints.*"],
    "Application": ["*.Application.*", "*.Application", "*.Services.*", "*.Handlers.*", "*.Commands.*", "*.Queries.*", "*.UseCases.*", "*.Mediator.*", "*.Cqrs.*"],
    "Domain": ["*.Domain.*", "*.Domain", "*.Core.*", "*.Entities.*", "*.Models.*", "*.ValueObjects.*", "*.Aggregates.*", "*.DomainServices.*", "*.DomainEvents.*"],
    "Infrastructure": ["*.Infrastructure.*", "*.Infrastructure", "*.Data.*", "*.Repositories.*", "*.Persistence.*", "*.EntityFramework.*", "*.Ef.*", "*.Sql.*", "*.External.*", "*.Adapters.*"],
    "Shared": ["*.Shared.*", "*.Common.*", "*.CrossCutting.*", "*.Extensions.*", "*.Utilities.*", "*.Helpers.*", "*.Logging.*", "*.Exceptions.*"],
}
#: Type-name endings that decide a layer: ending, layer, confidence.
LAYER_ENDINGS = [("Controller", "Presentation", 1.0), ("Repository", "Infrastructure", 1.0), ("DbContext", "Infrastructure", 1.0), ("Handler", "Application", 1.0), ("Service", "Application", 0.9)]
#: Layers that a layer may depend on.
LEGAL: dict[str, list[str]] = {
    "Presentation": ["Application", "Domain", "Shared"],
    "Application": ["Domain", "Shared"],
    "Domain": ["Shared"],
    "Infrastructure": ["Domain", "Shared"],
    "Shared": [],
}
#: Default dependency rules.
DEFAULT_RULES: list[dict] = [
    {"name": "Domain → Infrastructure", "from": "*.Domain.*", "to": "*.Infrastructure.*", "type": "Forbidden", "severity": "Error"},
    {"name": "Domain → Presentation", "from": "*.Domain.*", "to": "*.Controllers.*", "type": "Forbidden", "severity": "Error"},
    {"name": "Domain → Api", "from": "*.Domain.*", "to": "*.Api.*", "type": "Forbidden", "severity": "Error"},
    {"name": "Domain → Web", "from": "*.Domain.*", "to": "*.Web.*", "type": "Forbidden", "severity": "Error"},
    {"name": "Application → Presentation", "from": "*.Application.*", "to": "*.Controllers.*", "type": "Forbidden", "severity": "Error"},
    {"name": "Application → Api", "from": "*.Application.*", "to": "*.Api.*", "type": "Forbidden", "severity": "Error"},
    {"name": "Infrastructure → Presentation", "from": "*.Infrastructure.*", "to": "*.Controllers.*", "type": "Forbidden", "severity": "Error"},
    {"name": "Service → Controller", "from": "*.Services.*", "to": "*.Controllers.*", "type": "Forbidden", "severity": "Error"},
    {"name": "Handler → Controller", "from": "*.Handlers.*", "to": "*.Controllers.*", "type": "Forbidden", "severity": "Error"},
    {"name": "Repository → Service", "from": "*.Repositories.*", "to": "*.Services.*", "type": "Forbidden", "severity": "Warning"},
    {"name": "Entity → DbContext", "from": "*.Entities.*", "to": "*.DbContext*", "type": "Forbidden", "severity": "Error"},
    {"name": "Entity → Repository", "from": "*.Entities.*", "to": "*.Repositories.*", "type": "Forbidden", "severity": "Error"},
]
#: Words of protection levels; the reasons of detect_layers() are fixed as well.
LEVEL_WORDS = {"DoNotModify": "DO NOT MODIFY", "RequireApproval": "REQUIRES APPROVAL", "Deprecated": "DEPRECATED"}


def _keyword(pattern: str) -> str:
    return pattern.replace("*.", "").replace(".*", "").replace("*", "")


def detect_layers(t: GraphTables, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """type_id (namespace and name), layer, confidence and reason of every type with methods.

    Name endings decide first; then the best of the patterns against full name (1), namespace (0.95), as its end (0.9)
    or as part of it (0.8), the first among equals; then a keyword in namespace or name (0.5). Patterns are few, so they are
    literal expressions over one row of each type instead of a join."""
    patterns = patterns or LAYER_PATTERNS
    rows = tree(t, include_private=True, skip_tests=True).groupBy("namespace", "type").agg(F.min("kind").alias("kind"))
    full = F.concat_ws(".", "namespace", "type")
    made = lambda layer, conf, why: F.struct(F.lit(layer).alias("layer"), F.lit(float(conf)).alias("confidence"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    flat = [(layer, p) for layer, ps in patterns.items() for p in ps]
    levels: list[tuple[Column, Column]] = []
    for ending, layer, conf in LAYER_ENDINGS:
        hit = F.col("type").endswith(ending)
        if ending == "Service":
            hit = hit & ~F.col("namespace").contains("Domain")
        levels.append((hit, made(layer, conf, f"Type name ends with {ending}")))
    levels += [(glob(full, p), made(layer, 1.0, f"Namespace pattern: {p}")) for layer, p in flat]
    levels += [(glob("namespace", p), made(layer, 0.95, f"Namespace pattern: {p}")) for layer, p in flat]
    lower = lambda c, s: F.contains(F.lower(F.col(c)), F.lit(s.lower()))
    ends = lambda p: F.lower("namespace").endswith(p.rstrip(".*").lower())
    levels += [(ends(p), made(layer, 0.9, f"Namespace pattern: {p}")) for layer, p in flat if p.rstrip(".*")]
    levels += [(lower("namespace", p.rstrip(".*").replace("*.", "")), made(layer, 0.8, f"Namespace pattern: {p}")) for layer, p in flat if p.rstrip(".*").replace("*.", "")]
    levels += [(lower("namespace", _keyword(p)) | lower("type", _keyword(p)), made(layer, 0.5, f"Partial match: contains '{_keyword(p)}'")) for layer, p in flat if _keyword(p)]
    best = F.coalesce(*[F.when(c, s) for c, s in levels], made("Unknown", 0.0, "No pattern match"))
    return rows.select(full.alias("type_id"), best.alias("b")).select("type_id", "b.layer", "b.confidence", "b.reason")


def layer_allows(source: Column, target: Column) -> Column:
    """Whether a layer may depend on another; the same or an unknown one always."""
    legal = reduce(lambda a, b: a | b, [(source == s) & target.isin(*ts) for s, ts in LEGAL.items() if ts])
    return (source == target) | (source == "Unknown") | (target == "Unknown") | legal


def type_dependencies(t: GraphTables) -> DataFrame:
    """Distinct calls between types: from_type, to_type."""
    key = t.methods.select("id", group_key(F.col("full_name"), "type").alias("ty"))
    e = t.method_calls.join(key.withColumnRenamed("id", "caller_id").withColumnRenamed("ty", "from_type"), "caller_id").join(key.withColumnRenamed("id", "callee_id").withColumnRenamed("ty", "to_type"), "callee_id")
    return e.where("from_type <> to_type").select("from_type", "to_type").distinct()


def refine_layers(t: GraphTables, layers: DataFrame) -> DataFrame:
    """Lower a type's confidence by a tenth of it for each illegal dependency (0.1 at least), with a warning; raise it
    by 0.1 (0.9 at most) where it was under 0.8 and two or more dependencies are legal."""
    a = layers.select(F.col("type_id").alias("from_type"), F.col("layer").alias("from_layer"))
    b = layers.select(F.col("type_id").alias("to_type"), F.col("layer").alias("to_layer"))
    deps = type_dependencies(t).join(a, "from_type").join(b, "to_type").withColumn("ok", layer_allows(F.col("from_layer"), F.col("to_layer")))
    counts = deps.groupBy(F.col("from_type").alias("type_id")).agg(F.count_if(~F.col("ok")).alias("bad"), F.count_if("ok").alias("good"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.concat("from_layer", F.lit("→"), "to_layer")))), ", ").alias("which"))
    c = F.col("confidence")
    new = F.when(F.col("bad") > 0, F.greatest(F.lit(0.1), c * (1 - 0.1 * F.col("bad")))).when((c < 0.8) & (F.col("good") >= 2), F.least(F.lit(0.9), c + 0.1)).otherwise(c)
    reason = F.when(F.col("bad") > 0, F.concat("reason", F.lit("; violations: "), "which")).otherwise(F.col("reason"))
    return layers.join(counts, "type_id", "left").select("type_id", "layer", F.round(new, 6).alias("confidence"), reason.alias("reason"))


def filter_layers(layers: DataFrame, layer: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Rows of a layer and confidence, with the layer's rank."""
    order = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")) - 1
    out = layers.where(F.col("confidence") >= min_confidence).withColumn("layer_rank", order.cast("int"))
    return out.where(F.lower("layer") == layer.lower()) if layer else out


def violations(t: GraphTables, rules: list[dict] | None = None) -> DataFrame:
    """A row for each call between known methods and forbidding rule that it breaks.

    Each method's full name is matched once with each pattern, not each call with each rule: rules' sides become a
    list of rule numbers per method, and a call breaks those in both lists."""
    rules = [r for r in (DEFAULT_RULES if rules is None else rules) if r.get("type", "Forbidden") == "Forbidden"]
    side = lambda k: F.filter(F.array(*[F.when(glob("full_name", r[k]), F.lit(i)) for i, r in enumerate(rules)]) if rules else F.array().cast("array<int>"), lambda x: x.isNotNull())
    m = t.methods.select("id", "full_name")
    callers = m.select(F.col("id").alias("caller_id"), F.col("full_name").alias("caller"), side("from").alias("f")).where(F.size("f") > 0)
    callees = m.select(F.col("id").alias("callee_id"), F.col("full_name").alias("callee"), side("to").alias("g")).where(F.size("g") > 0)
    hits = t.method_calls.join(callers, "caller_id").join(callees, "callee_id").select("caller_id", "callee_id", "caller", "callee", F.explode(F.array_intersect("f", "g")).alias("i"))
    name = F.element_at(F.array(*[F.lit(r["name"]) for r in rules]) if rules else F.array(F.lit("")), F.col("i") + 1)
    severity = F.element_at(F.array(*[F.lit(r.get("severity", "Error")) for r in rules]) if rules else F.array(F.lit("")), F.col("i") + 1)
    why = F.element_at(F.array(*[F.lit(r.get("description", "")) for r in rules]) if rules else F.array(F.lit("")), F.col("i") + 1)
    return hits.select("caller_id", "callee_id", "caller", "callee", name.alias("rule"), severity.alias("severity"), why.alias("description"))


def violation_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "Error").alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings"))


def check_summary(t: GraphTables, rules: list[dict] | None = None) -> DataFrame:
    """One row: violations, errors, warnings, calls_checked and rules_applied (all rules, the allowing ones too)."""
    rules = DEFAULT_RULES if rules is None else rules
    found = violations(t, rules).agg(F.count("*").alias("violations"), F.count_if(F.col("severity") == "Error").alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings"))
    return found.crossJoin(calls_checked(t)).withColumn("rules_applied", F.lit(len(rules)))  # one row each


def calls_checked(t: GraphTables) -> DataFrame:
    """Out-calls of known methods, known callees or not."""
    return t.method_calls.join(t.methods.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").agg(F.count("*").alias("calls_checked"))


def protected(methods: DataFrame, zones: list[dict]) -> DataFrame:
    """Methods in a protected zone: the first that matches in list order, with its warning."""
    if not zones:
        return methods.where("false").select("id", "full_name", *[F.lit("").alias(c) for c in ("pattern", "level", "warning")])
    made = [
        F.when(
            glob("full_name", z["pattern"]),
            F.struct(F.lit(z["pattern"]).alias("pattern"), F.lit(z["level"]).alias("level"), F.lit(f"[{LEVEL_WORDS.get(z['level'], z['level'].upper())}] {z.get('reason', '')}" + (f" (Contact: {z['owner']})" if z.get("owner") else "")).alias("warning")),
        )
        for z in zones
    ]
    return methods.select("id", "full_name", F.coalesce(*made).alias("z")).where("z is not null").select("id", "full_name", "z.pattern", "z.level", "z.warning")


def tests_of(t: GraphTables, name: str) -> DataFrame:
    """Methods whose names hold `name` and Test in either order."""
    return t.methods.where(contains("full_name", f"{name}%Test") | contains("full_name", f"Test%{name}")).select("id", "full_name")
