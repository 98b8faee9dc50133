"""Star-schema tables as a code graph, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callatlas.sources.tables import GraphTables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str, cyclic: bool = False) -> DataFrame:
    """Consecutive parts of an order call each other; with `cyclic` in any direction, else from smaller to larger."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = lines.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"))
    pairs = pairs.where("a <> b" if cyclic else "a < b").distinct()
    return pairs.select(F.col("a").cast("string").alias("caller_id"), F.col("b").cast("string").alias("callee_id"))


def graph(spark: SparkSession, sf_dir: str, before: str | None = None, cyclic: bool = False, since: str | None = None) -> GraphTables:
    """The tables as code: regions are projects, nations namespaces, suppliers types, parts methods, runs of parts in
    an order calls. With `before`, only lines of orders before that date: an older snapshot; with `since`, from it on."""
    plain = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    region, nation, supplier, part = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    if before:
        lines = lines.join(read(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(before).cast("timestamp")).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    if since:
        lines = lines.join(read(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit(since).cast("timestamp")).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    per = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s_suppkey"), F.count("*").alias("loc"), F.countDistinct("l_linenumber").alias("nesting"))
    places = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at any scale
    kind = F.when(F.col("s_suppkey") % 7 == 0, "Interface").otherwise("Class")
    typed = places.select("s_suppkey", kind.alias("kind"), F.concat_ws(".", plain("r_name"), plain("n_name")).alias("ns"), plain("s_name").alias("tname"))
    m = part.join(per, F.col("p_partkey") == F.col("l_partkey")).join(typed, "s_suppkey")
    full = F.concat(F.lit("void "), F.col("ns"), F.lit("."), F.col("tname"), F.lit("."), plain("p_name"), F.lit("_"), F.col("p_partkey"), F.lit("()"))
    key = F.col("p_partkey").cast("string")
    bits = {"is_static": 3, "is_async": 5, "is_virtual": 7, "is_override": 11, "is_abstract": 13}
    methods = m.select(
        key.alias("id"), F.concat(plain("p_name"), F.lit("_"), F.col("p_partkey")).alias("name"), full.alias("full_name"), F.lit("void").alias("return_type"), F.col("s_suppkey").cast("string").alias("type_id"),
        (F.col("p_partkey") % 1000).cast("int").alias("start_line"), (F.col("p_partkey") % 1000 + F.col("loc")).cast("int").alias("end_line"), F.concat(F.lit("/src/"), F.col("tname"), F.lit(".cs")).alias("file_path"),
        *[(F.col("p_partkey") % n == 0).alias(c) for c, n in bits.items()], F.when(F.col("p_partkey") % 4 == 0, "Private").otherwise("Public").alias("accessibility"),
    )
    metrics = m.select(key.alias("method_id"), F.col("p_size").cast("int").alias("cognitive_complexity"), F.col("loc").cast("int").alias("lines_of_code"), F.col("nesting").cast("int").alias("nesting_depth"), (F.col("p_partkey") % 90).cast("int").alias("blast_radius"), (F.col("p_partkey") % 9).cast("int").alias("blast_depth"))
    emb = read(spark, sf_dir, "embeddings")
    text = read(spark, sf_dir, "documents")
    ids = lambda c: F.col(c).cast("string")
    return GraphTables(spark).with_tables(
        projects=region.select(ids("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("/src/"), F.col("r_name"), F.lit(".csproj")).alias("file_path")),
        namespaces=nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("ns:"), F.col("n_nationkey")).alias("id"), F.concat_ws(".", plain("r_name"), plain("n_name")).alias("full_name"), ids("n_regionkey").alias("project_id")),
        types=places.select(ids("s_suppkey").alias("id"), plain("s_name").alias("name"), F.concat_ws(".", plain("r_name"), plain("n_name"), plain("s_name")).alias("full_name"), kind.alias("kind"), F.concat(F.lit("ns:"), F.col("n_nationkey")).alias("namespace_id")),
        methods=methods, metrics=metrics, method_calls=calls(spark, sf_dir, cyclic),
        embeddings=emb.select(ids("vec_id").alias("method_id"), F.col("embedding").alias("vector"), F.lit("hash").alias("model_version")),
        normalized_methods=text.select(ids("doc_id").alias("method_id"), F.col("text").alias("structural_signature"), F.col("text").alias("semantic_payload")),
        intent_clusters=emb.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).select(F.concat(F.lit("cluster-"), F.col("label")).alias("id"), F.concat(F.lit("label "), F.col("label")).alias("label"), F.lit(None).cast("string").alias("description"), F.lit(1.0).alias("cohesion"), F.col("n").alias("member_count")),
        method_cluster_map=emb.where("label is not null").select(ids("vec_id").alias("method_id"), F.concat(F.lit("cluster-"), F.col("label")).alias("cluster_id")),
    )
