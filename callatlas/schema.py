"""Logical tables of a code graph and their schemas."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "projects": "id string, name string, file_path string",
    "namespaces": "id string, full_name string, project_id string",
    "types": "id string, name string, full_name string, kind string, namespace_id string, is_static boolean, is_abstract boolean, is_sealed boolean",
    "methods": "id string, name string, full_name string, return_type string, type_id string, start_line int, end_line int, file_path string, is_static boolean, is_async boolean, is_virtual boolean, is_override boolean, is_abstract boolean, accessibility string",
    "method_calls": "caller_id string, callee_id string",
    "type_implements": "type_id string, interface_id string",
    "metrics": "method_id string, cognitive_complexity int, lines_of_code int, nesting_depth int, blast_radius int, blast_depth int",
    "normalized_methods": "method_id string, structural_signature string, semantic_payload string",
    "embeddings": "method_id string, vector array<float>, model_version string",
    "clone_pairs": "method_id_a string, method_id_b string, structural_similarity float, semantic_similarity float, hybrid_score float, clone_type string",
    "intent_clusters": "id string, label string, description string, cohesion float, member_count int",
    "method_cluster_map": "method_id string, cluster_id string",
    "metadata": "key string, value string",
    "type_layers": "type_id string, layer string, confidence float, reason string",
}

KEYS: dict[str, list[str]] = {
    "projects": ["id"],
    "namespaces": ["id"],
    "types": ["id"],
    "methods": ["id"],
    "method_calls": ["caller_id", "callee_id"],
    "type_implements": ["type_id", "interface_id"],
    "metrics": ["method_id"],
    "normalized_methods": ["method_id"],
    "embeddings": ["method_id"],
    "clone_pairs": ["method_id_a", "method_id_b"],
    "intent_clusters": ["id"],
    "method_cluster_map": ["method_id", "cluster_id"],
    "metadata": ["key"],
    "type_layers": ["type_id"],
}

#: Layers in rank order.
LAYERS = ["Presentation", "Application", "Domain", "Infrastructure", "Shared", "Unknown"]


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
