"""Ranked, filtered and joined views of the graph tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callatlas.functions.text import base_name, contains, group_key, risk
from callatlas.sources.tables import GraphTables, call_edges

#: Names that are never dead code.
ENTRY_NAMES = [".ctor", ".cctor", "Main", "Dispose", "DisposeAsync"]


def method_info(t: GraphTables, method_id: str) -> DataFrame:
    """Point lookup; the key is pushed down to the scan."""
    m = t.methods.where(F.col("id") == method_id)
    return m.join(t.metrics.withColumnRenamed("method_id", "id"), "id", "left")


def search_methods(t: GraphTables, pattern: str) -> DataFrame:
    return t.methods.where(contains("full_name", pattern)).select("id", "name", "full_name", "file_path", "start_line")


def hotspots(t: GraphTables, top: int = 20, threshold: int | None = None, by: str = "complexity") -> DataFrame:
    """Methods by complexity, blast radius or risk; the top-k runs per partition first. Ties: smaller id."""
    rows = t.methods.select("id", "full_name", "file_path", "start_line").join(t.metrics, F.col("id") == F.col("method_id"))
    if threshold is not None:
        rows = rows.where(F.col("cognitive_complexity") >= threshold)
    cc, br = F.col("cognitive_complexity"), F.col("blast_radius")
    key = {"complexity": cc, "blast": br, "risk": cc * (1 + F.log10(br + 1.0))}[by]
    second = cc if by == "blast" else br
    out = rows.orderBy(F.desc(key), F.desc(second), "id").limit(top)
    return out.select("id", "full_name", base_name(F.col("file_path")).alias("file"), "start_line", "cognitive_complexity", "lines_of_code", "nesting_depth", "blast_radius", F.round(risk(cc, br), 4).alias("risk"))


def tree(t: GraphTables, namespace: str | None = None, type_name: str | None = None, include_private: bool = False, include_constructors: bool = False, skip_tests: bool = False, skip_interfaces: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """project, namespace, type and method rows; types without methods have none."""
    p, n, y, m = t.projects, t.namespaces, t.types, t.methods
    rows = (
        m.select(F.col("id").alias("method_id"), F.col("name").alias("method"), "return_type", "accessibility", "type_id")
        .join(y.select(F.col("id").alias("type_id"), F.col("name").alias("type"), F.col("kind"), "namespace_id"), "type_id")
        .join(n.select(F.col("id").alias("namespace_id"), F.col("full_name").alias("namespace"), "project_id"), "namespace_id")
        .join(p.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    )
    terms: list[Column] = []
    if namespace:
        terms.append(F.col("namespace").ilike(f"{namespace}%"))
    if type_name:
        terms.append(contains("type", type_name))
    if not include_constructors:
        terms.append(~F.col("method").isin(".ctor", ".cctor"))
    if not include_private:
        terms.append(F.col("accessibility") == "Public")
    if skip_tests:
        terms.append(~contains("project", "Test"))
    if skip_interfaces:
        terms.append(F.col("kind") != "Interface")
    terms += [~contains("namespace", x.strip()) for x in exclude if x.strip()]
    rows = rows.where(reduce(lambda a, b: a & b, terms)) if terms else rows
    return rows.select("project", "namespace", "type", "kind", "method", "return_type", "accessibility", "method_id")


def tree_top(rows: DataFrame, n: int = 3) -> DataFrame:
    """First n method names of each type and how many more there are. Counts come from a partial aggregation; names
    from a windowed top-n, which Spark cuts before shuffling, so a type of many methods is never gathered."""
    keys = ["project", "namespace", "type"]
    totals = rows.groupBy(*keys).agg(F.count("*").alias("n_methods"))
    top = rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("method", "method_id"))).where(F.col("rn") <= n)
    names = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "method"))), lambda s: s["method"]), ",").alias("first_methods"))
    return names.join(totals, keys).withColumn("more", F.greatest(F.lit(0), F.col("n_methods") - n)).select(*keys, "first_methods", "n_methods", "more")


def dead_code(t: GraphTables, include_overrides: bool = False) -> DataFrame:
    """Methods that nothing calls, without entry points and tests."""
    m = t.methods.where(~F.col("name").isin(*ENTRY_NAMES) & ~contains("name", "Test") & ~F.col("name").ilike("%_Test"))
    if not include_overrides:
        m = m.where("not is_override and not is_abstract")
    called = t.method_calls.select(F.col("callee_id").alias("id")).where("id is not null")
    m = m.join(called, "id", "left_anti")
    y = t.types.where(~F.col("name").ilike("%Tests") & ~F.col("name").ilike("%Test")).select(F.col("id").alias("type_id"), "namespace_id")
    n = t.namespaces.where(~contains("full_name", "Tests")).select(F.col("id").alias("namespace_id"))
    m = m.join(y, "type_id").join(n, "namespace_id")
    metrics = t.metrics.select(F.col("method_id").alias("id"), "cognitive_complexity")
    return m.join(metrics, "id", "left").select("id", "full_name", "file_path", "start_line", F.coalesce("cognitive_complexity", F.lit(0)).alias("cognitive_complexity"))


def coupling(t: GraphTables, level: str = "namespace") -> DataFrame:
    """Afferent and efferent call counts across groups, instability, abstractness and distance from the main sequence.

    Both counts come from one aggregation over the edges; the name of every method is looked up once per end."""
    g = t.methods.select("id", group_key(F.col("full_name"), level).alias("grp"))
    e = t.method_calls.join(g.withColumnRenamed("id", "caller_id").withColumnRenamed("grp", "from_group"), "caller_id").join(g.withColumnRenamed("id", "callee_id").withColumnRenamed("grp", "to_group"), "callee_id")
    crossing = e.where("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count("*").alias("n"))
    ends = crossing.select(F.explode(F.array(F.struct(F.col("from_group").alias("grp"), F.col("n").alias("ce"), F.lit(0).cast("long").alias("ca")), F.struct(F.col("to_group").alias("grp"), F.lit(0).cast("long").alias("ce"), F.col("n").alias("ca")))).alias("x"))
    counts = ends.groupBy("x.grp").agg(F.sum("x.ca").alias("ca"), F.sum("x.ce").alias("ce"))
    typed = t.methods.select("type_id").distinct().join(t.types.select(F.col("id").alias("type_id"), "kind", "name", "namespace_id"), "type_id").join(t.namespaces.select(F.col("id").alias("namespace_id"), F.col("full_name").alias("ns")), "namespace_id")
    key = F.col("ns") if level == "namespace" else F.concat_ws(".", "ns", "name")
    kinds = typed.select(key.alias("grp"), (F.col("kind").isin("Interface", "Abstract")).cast("int").alias("abstract")).groupBy("grp").agg((F.sum("abstract") / F.count("*")).alias("abstractness"))
    rows = g.select("grp").where("grp <> ''").distinct().join(counts, "grp", "left").join(kinds, "grp", "left")
    rows = rows.select("grp", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"), F.coalesce("abstractness", F.lit(0.0)).alias("a"))
    rows = rows.withColumn("i", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0))
    return rows.select("grp", "ca", "ce", F.bround("i", 4).alias("instability"), F.bround("a", 4).alias("abstractness"), F.bround(F.abs(F.col("a") + F.col("i") - 1), 4).alias("distance"))


def export_methods(t: GraphTables, concept: str | None = None) -> DataFrame:
    """Methods with metrics and cluster; with a concept only those of clusters whose label contains it."""
    how = "inner" if concept else "left"
    clusters = t.intent_clusters.select(F.col("id").alias("cluster_id"), F.col("label").alias("cluster_label"))
    if concept:
        clusters = clusters.where(contains("cluster_label", concept))
    mapped = t.method_cluster_map.join(clusters, "cluster_id").select(F.col("method_id").alias("id"), "cluster_label")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = t.methods.select("id", "full_name", "file_path", "start_line").join(t.metrics.withColumnRenamed("method_id", "id"), "id", "left").join(mapped, "id", how)
    return rows.select("id", "full_name", "file_path", "start_line", zero("cognitive_complexity"), zero("lines_of_code"), zero("nesting_depth"), "cluster_label")


def induced_calls(t: GraphTables, ids: DataFrame) -> DataFrame:
    """Calls with either end among `ids` (column id)."""
    keys = ids.select("id").distinct()
    out = t.method_calls.join(keys.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").select("caller_id", "callee_id")
    into = t.method_calls.join(keys.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").select("caller_id", "callee_id")
    return out.union(into).distinct()


def clone_pairs(t: GraphTables, threshold: float = 0.0, clone_type: str | None = None, concept: str | None = None) -> DataFrame:
    """Stored pairs by predicates; a concept keeps pairs with either end in a cluster whose label contains it."""
    p = t.clone_pairs
    if threshold > 0:
        p = p.where(F.col("hybrid_score") >= F.lit(threshold).cast("float"))
    if clone_type:
        p = p.where(F.col("clone_type") == clone_type)
    if concept:
        inside = t.method_cluster_map.join(t.intent_clusters.where(contains("label", concept)).select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").select("method_id").distinct()
        a = p.join(inside.withColumnRenamed("method_id", "method_id_a"), "method_id_a", "left_semi").select(*p.columns)
        b = p.join(inside.withColumnRenamed("method_id", "method_id_b"), "method_id_b", "left_semi").select(*p.columns)
        p = a.union(b).distinct()
    return p


def duplicates_of(t: GraphTables, method_id: str) -> DataFrame:
    """Clones of a method: the other end of its pairs, by name where it is known."""
    p = t.clone_pairs.where((F.col("method_id_a") == method_id) | (F.col("method_id_b") == method_id))
    p = p.withColumn("other_id", F.when(F.col("method_id_a") == method_id, F.col("method_id_b")).otherwise(F.col("method_id_a")))
    names = t.methods.select(F.col("id").alias("other_id"), "full_name")
    return p.join(names, "other_id", "left").select("other_id", F.coalesce("full_name", "other_id").alias("other_name"), "hybrid_score", "clone_type")


def degrees(t: GraphTables) -> DataFrame:
    """Afferent and efferent calls of every method that has any."""
    ends = t.method_calls.select(F.explode(F.array(F.struct(F.col("caller_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("callee_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").alias("afferent"), F.sum("x.o").alias("efferent"))


def entry_points(t: GraphTables) -> DataFrame:
    """Methods without known callers."""
    called = call_edges(t.method_calls, t.methods).select(F.col("callee_id").alias("id"))
    return t.methods.join(called, "id", "left_anti").select("id", "full_name")


def churn(t: GraphTables, commits: DataFrame, since: str | None = None) -> DataFrame:
    """Commits of a method's file times its complexity; commits: file_path, ts."""
    if since:
        commits = commits.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    n = commits.groupBy("file_path").agg(F.count("*").alias("commits"))
    m = t.methods.select("id", "full_name", "file_path").join(t.metrics.where("cognitive_complexity > 0").select(F.col("method_id").alias("id"), "cognitive_complexity"), "id")
    return m.join(n, "file_path").select("id", "full_name", "file_path", "commits", "cognitive_complexity", (F.col("commits") * F.col("cognitive_complexity")).alias("churn_score"))


def diff(t: GraphTables, changed: DataFrame) -> DataFrame:
    """Methods in changed files (column path): by full path, or by file name if no path matches."""
    m = t.methods.join(t.metrics.select(F.col("method_id").alias("id"), "cognitive_complexity"), "id", "left").select("id", "full_name", "file_path", F.coalesce("cognitive_complexity", F.lit(0)).alias("cognitive_complexity"))
    path = changed.select(F.lower("path").alias("k")).distinct()
    exact = m.withColumn("k", F.lower("file_path")).join(path, "k", "left_semi").drop("k")
    if not exact.isEmpty():
        return exact
    return m.withColumn("k", F.lower(base_name(F.col("file_path")))).join(path.select(base_name(F.col("k")).alias("k")).distinct(), "k", "left_semi").drop("k")


def diff_complex(found: DataFrame, over: int = 10, top: int = 10) -> DataFrame:
    """Of diff()'s methods the most complex ones, those over a complexity only."""
    return found.where(F.col("cognitive_complexity") > over).orderBy(F.desc("cognitive_complexity"), "id").limit(top)


def export_edges(t: GraphTables, concept: str | None = None) -> DataFrame:
    """Calls with either end among the exported methods."""
    return induced_calls(t, export_methods(t, concept).select("id"))


def export_counts(t: GraphTables, concept: str | None = None) -> DataFrame:
    """One row: methods, relationships and the concept of an export."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(export_methods(t, concept), "method_count").crossJoin(one(export_edges(t, concept), "relationship_count")).withColumn("concept", F.lit(concept).cast("string"))  # one row each


def export(t: GraphTables, path: str, form: str = "json", concept: str | None = None) -> None:
    """Write an export below `path`, a folder for each part: methods, relationships and counts; CSV in full quotes
    where a value needs them."""
    if form not in ("json", "csv", "parquet"):
        raise ValueError("form is one of json, csv, parquet")
    parts = {"methods": export_methods(t, concept), "relationships": export_edges(t, concept), "counts": export_counts(t, concept)}
    for name, df in parts.items():
        w = df.write.mode("overwrite")
        w = w.option("header", "true").option("escape", '"').option("quote", '"') if form == "csv" else w
        w.format(form).save(f"{path}/{name}")


def top_with_more(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in an order, each with its rank, the number of all rows and how many are not shown. Both come
    from one pass with partial results; no partition is gathered."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(*order).limit(n)  # n rows at most from here on
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return ranked.crossJoin(total).withColumn("more", F.greatest(F.lit(0), F.col("total") - n).cast("long"))  # one row


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their rank; Spark cuts each partition to the first ranks before shuffling."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def ordered_tree(rows: DataFrame) -> DataFrame:
    """tree()'s rows by project, namespace, type and method."""
    return rows.orderBy("project", "namespace", "type", "method", "method_id")


def cluster_of(t: GraphTables, method_id: str) -> DataFrame:
    """The cluster of a method: cluster_id, label, cohesion, member_count."""
    return t.method_cluster_map.where(F.col("method_id") == method_id).join(t.intent_clusters.withColumnRenamed("id", "cluster_id"), "cluster_id").select("cluster_id", "label", "cohesion", "member_count")


def summary(t: GraphTables) -> DataFrame:
    """Totals and averages of a build."""
    m = t.metrics.agg(F.count("*").alias("n_metrics"), F.round(F.avg("cognitive_complexity"), 4).alias("avg_complexity"), F.max("blast_radius").alias("max_blast"), F.count_if(F.col("blast_radius") > 10).alias("n_high_impact"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return m.crossJoin(one(t.methods, "n_methods")).crossJoin(one(t.types, "n_types")).crossJoin(one(t.method_calls, "n_calls"))  # one row each


def resolve_method(t: GraphTables, name: str) -> DataFrame:
    """Candidates of the best kind: id, then exact full name, then substring of the full name, then Type.Method tail.
    `unique` tells whether there is only one."""
    from callatlas.functions.text import tail_name

    m = t.methods.select("id", "full_name")
    kind = F.when(F.col("id") == name, 0).when(F.col("full_name") == name, 1).when(tail_name(F.col("full_name")) == name, 2).when(contains("full_name", name), 3)
    found = m.withColumn("kind", kind).where("kind is not null")
    best = found.agg(F.min("kind").alias("kind"))
    out = found.join(F.broadcast(best), "kind", "left_semi")  # one row
    return out.crossJoin(F.broadcast(out.agg((F.count("*") == 1).alias("unique")))).select("id", "full_name", "kind", "unique")


def staleness(spark, metadata: DataFrame, head: str | None, newest_source: str | None, now: str, solution_changed: str | None = None) -> DataFrame:
    """One row: stale, level and reason of a store against the repository it was built from."""
    kv = {r[0]: r[1] for r in metadata.where(F.col("key").isin("analyzed_at", "commit")).select("key", "value").collect()}
    base = spark.range(1).select(F.lit(kv.get("analyzed_at")).cast("timestamp").alias("at"), F.lit(kv.get("commit")).alias("commit"), F.lit(head).alias("head"), F.lit(newest_source).cast("timestamp").alias("newest"), F.lit(now).cast("timestamp").alias("now"), F.lit(solution_changed).cast("timestamp").alias("solution"))
    cases = [
        (F.col("at").isNull(), "high", "never analyzed"),
        (F.col("commit").isNotNull() & F.col("head").isNotNull() & (F.col("commit") != F.col("head")), "high", "commit differs"),
        (F.col("newest") > F.col("at"), "medium", "sources are newer"),
        (F.col("solution") > F.col("at"), "medium", "solution is newer"),
        (F.datediff("now", "at") > 7, "low", "older than a week"),
    ]
    pick = lambda k, other: reduce(lambda e, c: e.when(c[0], c[k]), cases[1:], F.when(cases[0][0], cases[0][k])).otherwise(other)
    return base.select((pick(1, "none") != "none").alias("stale"), pick(1, "none").alias("level"), pick(2, "current").alias("reason"))
