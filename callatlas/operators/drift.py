"""Differences between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callatlas.sources.tables import GraphTables


def new_methods(current: GraphTables, baseline: GraphTables) -> DataFrame:
    return current.methods.join(baseline.methods.select("id"), "id", "left_anti").select("id", "full_name")


def removed_methods(current: GraphTables, baseline: GraphTables) -> DataFrame:
    return new_methods(baseline, current)


def regressions(current: GraphTables, baseline: GraphTables, percent: float = 0.25, absolute: int = 15) -> DataFrame:
    """Methods whose complexity rose by a share of at least `percent` or past `absolute`; from 0 the share is 1."""
    c = current.metrics.select(F.col("method_id").alias("id"), F.col("cognitive_complexity").alias("current_cc"))
    b = baseline.metrics.select(F.col("method_id").alias("id"), F.col("cognitive_complexity").alias("base_cc"))
    share = F.when(F.col("base_cc") == 0, F.lit(1.0)).otherwise((F.col("current_cc") - F.col("base_cc")) / F.when(F.col("base_cc") != 0, F.col("base_cc")))
    rows = c.join(b, "id").where("current_cc > base_cc").withColumn("share", share)
    return rows.where((F.col("share") >= percent) | ((F.col("base_cc") <= absolute) & (F.col("current_cc") > absolute))).select("id", "base_cc", "current_cc", F.round("share", 4).alias("share"))


def new_duplicates(current: GraphTables, baseline: GraphTables) -> DataFrame:
    keys = ["method_id_a", "method_id_b"]
    return current.clone_pairs.join(baseline.clone_pairs.select(*keys), keys, "left_anti").select(*keys, "hybrid_score", "clone_type")


def _label_places(t: GraphTables) -> DataFrame:
    ns = t.methods.select(F.col("id").alias("method_id"), "type_id").join(t.types.select(F.col("id").alias("type_id"), "namespace_id"), "type_id").join(t.namespaces.select(F.col("id").alias("namespace_id"), F.col("full_name").alias("ns")), "namespace_id")
    return t.method_cluster_map.join(t.intent_clusters.select(F.col("id").alias("cluster_id"), "label"), "cluster_id").join(ns, "method_id").select("label", "ns").distinct()


def scattering(current: GraphTables, baseline: GraphTables) -> DataFrame:
    """Labels of the baseline whose methods now lie in more namespaces: label, new_namespaces (a count), namespaces
    (those, sorted) and new_members (a count of methods that had not the label)."""
    c, b = _label_places(current), _label_places(baseline)
    gained = c.join(b, ["label", "ns"], "left_anti").join(b.select("label").distinct(), "label", "left_semi")
    named = gained.groupBy("label").agg(F.count("*").alias("new_namespaces"), F.array_sort(F.collect_list("ns")).alias("namespaces"))  # namespaces of one label
    joined = new_members(current, baseline).groupBy("label").agg(F.count("*").alias("new_members"))
    return named.join(joined, "label", "left").select("label", "new_namespaces", "namespaces", F.coalesce("new_members", F.lit(0)).alias("new_members"))


def _members(t: GraphTables) -> DataFrame:
    return t.method_cluster_map.join(t.intent_clusters.select(F.col("id").alias("cluster_id"), "label"), "cluster_id").select("label", F.col("method_id").alias("id")).distinct()


def new_members(current: GraphTables, baseline: GraphTables) -> DataFrame:
    """label and id of methods that have a label of the baseline now and had not then."""
    b = _members(baseline)
    return _members(current).join(b, ["label", "id"], "left_anti").join(b.select("label").distinct(), "label", "left_semi")


def method_details(t: GraphTables) -> DataFrame:
    """id, full_name, type and namespace of every method whose type and namespace are known."""
    y = t.types.select(F.col("id").alias("type_id"), F.col("full_name").alias("type"), "namespace_id")
    n = t.namespaces.select(F.col("id").alias("namespace_id"), F.col("full_name").alias("namespace"))
    return t.methods.select("id", "full_name", "type_id").join(y, "type_id").join(n, "namespace_id").select("id", "full_name", "type", "namespace")


def report(current: GraphTables, baseline: GraphTables) -> DataFrame:
    """All sections in one table: section, key, detail."""
    parts = [
        new_methods(current, baseline).select(F.lit("new").alias("section"), F.col("id").alias("key"), F.col("full_name").alias("detail")),
        removed_methods(current, baseline).select(F.lit("removed"), F.col("id"), F.col("full_name")),
        regressions(current, baseline).select(F.lit("regression"), F.col("id"), F.concat_ws(" to ", "base_cc", "current_cc")),
        new_duplicates(current, baseline).select(F.lit("duplicate"), F.concat_ws(" ~ ", "method_id_a", "method_id_b"), F.col("clone_type")),
        scattering(current, baseline).select(F.lit("scattering"), F.col("label"), F.col("new_namespaces").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def verdict(current: GraphTables, baseline: GraphTables) -> int:
    """Exit code: 1 if anything drifted."""
    return 0 if report(current, baseline).isEmpty() else 1
