"""Everything known about one method in one row, and the whole build from calls and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callatlas.functions.text import age_bucket, group_key, risk
from callatlas.operators import architecture, graph, relational, similarity
from callatlas.operators.embedding import EmbeddingEngine, HashEngine
from callatlas.sources import tables as T
from callatlas.sources.scratch import materialize


#: Names of entry points, recent members, lines of source and checked callees that a card shows.
ENTRIES, RECENT, LINES, CHECKED = 3, 3, 20, 20


def context(t: T.GraphTables, method_id: str, zones: list[dict] | None = None, shown: int = 5, commits: DataFrame | None = None, sources: DataFrame | None = None, blame: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """Metrics and risk, layer, protection, entry points, callers and callees, cluster and its recent activity,
    duplicates, tests, notes, source and last author of a method, in one row.

    Lists hold a few names; the counts beside them are whole. Each list is cut before it is gathered. Optional inputs:
    commits (file_path, ts) and the time `now` for activity, sources (path, text), blame (file_path, line, author, ts).
    """
    m = relational.method_info(t, method_id)
    names = t.methods.select("id", "full_name")
    spark = t.spark

    def few(df: DataFrame, name: str, n: int = shown, by: str = "full_name") -> DataFrame:
        total = df.agg(F.count("*").alias(f"n_{name}"))
        top = df.orderBy(by, "full_name").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), F.col("full_name").alias("full")))), lambda x: x["full"]).alias(name))
        return total.crossJoin(top)  # one row each

    calls = t.method_calls
    callers = calls.where(F.col("callee_id") == method_id).select(F.col("caller_id").alias("id")).join(names, "id")
    callees = materialize(calls.where(F.col("caller_id") == method_id).select(F.col("callee_id").alias("id")).join(names, "id"), "callees")
    entries = graph.entry_callers(t, method_id)
    clones = relational.duplicates_of(t, method_id).select(F.col("other_name").alias("full_name"), (-F.col("hybrid_score")).alias("by"))
    mine = t.method_cluster_map.where(F.col("method_id") == method_id).select("cluster_id")
    cluster = mine.join(t.intent_clusters.select(F.col("id").alias("cluster_id"), "label", "member_count", "cohesion"), "cluster_id").agg(F.min(F.struct("label", "member_count", "cohesion")).alias("c")).select(F.col("c.label").alias("cluster"), F.col("c.member_count").alias("cluster_members"), F.col("c.cohesion").alias("cluster_cohesion"))
    layers = t.type_layers.select(F.col("type_id").alias("layer_type"), "layer")
    zone = architecture.protected(t.methods.where(F.col("id") == method_id), zones or []).agg(F.first("warning", ignorenulls=True).alias("protection"))
    row = m.withColumn("layer_type", group_key(F.col("full_name"), "type")).join(layers, "layer_type", "left")
    first = m.select("name", "file_path", "start_line").first()
    tests = architecture.tests_of(t, first[0] if first else "").select("full_name")
    checked = callees.orderBy("full_name").limit(CHECKED)
    old = architecture.protected(checked, [z for z in zones or []]).where("level = 'Deprecated'").agg(F.array_sort(F.collect_list("full_name")).alias("deprecated"))
    theirs = checked.withColumn("layer_type", group_key(F.col("full_name"), "type")).join(layers, "layer_type").select(F.col("layer").alias("target"))
    crossed = row.select(F.col("layer").alias("source")).where("source is not null").crossJoin(theirs)  # one row with CHECKED at most
    crossed = crossed.where(~architecture.layer_allows(F.col("source"), F.col("target"))).agg(F.array_sort(F.collect_set(F.concat("source", F.lit("->"), "target"))).alias("crossed"))
    activity = spark.range(1).select(F.array().cast("array<string>").alias("recent"))
    if commits is not None:
        others = t.method_cluster_map.join(F.broadcast(mine), "cluster_id").where(F.col("method_id") != method_id).select(F.col("method_id").alias("id"))
        last = commits.groupBy("file_path").agg(F.max("ts").alias("ts"))
        latest = others.join(t.methods.select("id", "name", "file_path"), "id").join(last, "file_path").orderBy(F.desc("ts"), "id").limit(RECENT)
        when = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        told = F.concat("name", F.lit(" ("), age_bucket(F.col("ts"), when), F.lit(")"))
        activity = latest.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("ts")).alias("t"), "id", told.alias("told")))), lambda x: x["told"]).alias("recent"))
    text = spark.range(1).select(F.lit(None).cast("string").alias("source"))
    if sources is not None and first and first[1]:
        lines = F.slice(F.split("text", "\r?\n"), max(1, first[2] or 1), LINES)
        text = sources.where(F.col("path") == first[1]).agg(F.first(F.array_join(lines, "\n")).alias("source"))
    author = spark.range(1).select(F.lit(None).cast("string").alias("last_modified"))
    if blame is not None and first:
        author = blame.where((F.col("file_path") == first[1]) & (F.col("line") == first[2])).agg(F.max(F.concat("author", F.lit(" on "), F.date_format("ts", "yyyy-MM-dd"))).alias("last_modified"))
    parts = (few(entries, "entry_points", ENTRIES, "depth"), few(callers, "callers"), few(callees, "callees"), few(clones, "duplicates", 3, "by"), few(tests, "tests"), cluster, zone, old, crossed, activity, text, author)
    for part in parts:
        row = row.crossJoin(F.broadcast(part))  # one row each
    cc, br = F.coalesce("cognitive_complexity", F.lit(0)), F.coalesce("blast_radius", F.lit(0))
    notes = F.concat(
        F.filter(F.array(F.when(br > 50, "very high blast radius").when(br > 20, "high blast radius"), F.when(cc > 15, "high complexity"), F.col("protection")), lambda n: n.isNotNull()),
        F.transform("deprecated", lambda n: F.concat(F.lit("calls deprecated "), n)),
        F.when(F.size("crossed") > 0, F.array(F.concat(F.lit("layer violations: "), F.array_join("crossed", ", ")))).otherwise(F.array().cast("array<string>")),
    )
    lists = [c for x in ("entry_points", "callers", "callees", "duplicates", "tests") for c in (f"n_{x}", x)]
    return row.select("id", "full_name", "file_path", "start_line", cc.alias("cognitive_complexity"), "lines_of_code", "nesting_depth", br.alias("blast_radius"), F.round(risk(cc, br), 4).alias("risk"), "layer", "cluster", "cluster_members", "cluster_cohesion", *lists, "recent", "protection", notes.alias("notes"), "source", "last_modified")


def build(t: T.GraphTables, full: bool = True, engine: EmbeddingEngine | None = None) -> T.GraphTables:
    """Derived tables of a graph: blast radius into metrics, embeddings of payloads where there are none, clone pairs,
    layers and, with `full`, clusters with labels."""
    spark = t.spark
    blast = graph.blast_radius(t).select(F.col("id").alias("method_id"), F.col("transitive_callers").alias("blast_radius"), "blast_depth")
    out = t.with_tables(metrics=T.upsert_blast(t.metrics, blast))
    if t.embeddings.isEmpty():
        made_by = engine or HashEngine()
        vectors = made_by.embed(t.normalized_methods.select("method_id", F.col("semantic_payload").alias("text")))
        out = out.with_tables(embeddings=materialize(vectors.withColumn("model_version", F.lit(made_by.name)), "embeddings"))
    semantic = similarity.semantic_clones(out.embeddings).select(F.col("method_id_a").alias("a"), F.col("method_id_b").alias("b"), F.col("semantic_similarity").alias("similarity"))
    classes = similarity.structural_clones(t.normalized_methods).select("a", "b", "similarity")
    members = similarity.structural_members(t.normalized_methods)
    structural = similarity.pairs_among(materialize(semantic, "semantic"), classes, members)  # structural pairs alone never reach the least score
    layers = architecture.refine_layers(out, architecture.detect_layers(out))
    out = out.with_tables(clone_pairs=similarity.hybrid(structural, semantic), type_layers=layers)
    if full:
        grouped = materialize(similarity.dbscan(out.embeddings), "clusters")
        numbered = similarity.number_clusters(grouped).join(similarity.cluster_labels(grouped), "cluster").join(similarity.cohesion(out.embeddings, grouped), "cluster")
        ids = grouped.join(numbered.select("cluster", "cluster_id"), "cluster").select("method_id", "cluster_id")
        clusters = numbered.select(F.col("cluster_id").alias("id"), "label", F.concat(F.lit("Cluster of "), "member_count", F.lit(" methods")).alias("description"), "cohesion", "member_count")
        out = out.with_tables(method_cluster_map=ids, intent_clusters=clusters)
    return out.with_tables(metadata=T.upsert_metadata(t.metadata, spark.createDataFrame([("built", "true")], "key string, value string")))
