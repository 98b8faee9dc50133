"""Graph tables: lazy DataFrames, loading, saving, snapshots, upserts, vector and JSON files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from callatlas.schema import KEYS, TABLES, schema
from callatlas.sources.scratch import materialize


@dataclass
class GraphTables:
    """The tables of a snapshot. One that is not given is empty, as a missing table of a store is."""

    spark: SparkSession
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self.frames:
            self.frames[name] = self.spark.createDataFrame([], schema(name))
        return self.frames[name]

    def with_tables(self, **frames: DataFrame) -> GraphTables:
        return GraphTables(self.spark, self.frames | {k: conform(v, k) for k, v in frames.items()})


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table's schema, in order, cast to its types; absent ones take their defaults."""
    defaults = {"accessibility": F.lit("Public"), "kind": F.lit("Class"), "blast_radius": F.lit(0), "blast_depth": F.lit(0)}
    out = []
    for f in schema(table):
        base = F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(False) if f.dataType.simpleString() == "boolean" else F.lit(None))
        out.append(base.cast(f.dataType).alias(f.name))
    return df.select(*out)


def load(spark: SparkSession, root: str, snapshot: str = "current") -> GraphTables:
    """Tables of a snapshot below `root`; a table without files is empty, a snapshot without any is an error."""
    frames = {}
    for name in TABLES:
        try:
            frames[name] = spark.read.schema(schema(name)).parquet(f"{root}/snapshot={snapshot}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not frames:
        raise FileNotFoundError(f"no snapshot {snapshot} in {root}")
    return GraphTables(spark, frames)


def save(tables: GraphTables, root: str, snapshot: str = "current") -> None:
    """Overwrite a snapshot, first row of each key kept. Calls are sorted by callee, which caller lookups prune by.
    Rows are written as they come and only their keys are counted; a table is sorted by its keys if one repeats."""
    for name, df in tables.frames.items():
        path, keys = f"{root}/snapshot={snapshot}/{name}", KEYS[name]
        out = conform(df, name)
        if set(out.columns) <= set(keys):
            out = out.dropDuplicates(keys)
        if name == "method_calls":
            out = out.sortWithinPartitions("callee_id")
        out.write.mode("overwrite").parquet(path)
        back = tables.spark.read.schema(schema(name)).parquet(path)
        if not set(out.columns) <= set(keys) and not back.groupBy(*keys).count().where("count > 1").isEmpty():
            materialize(first_wins(back, keys), "first").write.mode("overwrite").parquet(path)


def save_baseline(spark: SparkSession, root: str) -> None:
    """Copy the current snapshot, whose keys are unique, to the baseline."""
    for name, df in load(spark, root).frames.items():
        df.write.mode("overwrite").parquet(f"{root}/snapshot=baseline/{name}")


def first_wins(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Insert-or-ignore: one row of each key, the first in `order` (default: all other columns)."""
    rest = order or [c for c in df.columns if c not in keys and not df.schema[c].dataType.simpleString().startswith(("map", "array"))]
    if not rest:
        return df.dropDuplicates(keys)
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*rest))).where("__n = 1").drop("__n")


def upsert_blast(metrics: DataFrame, blast: DataFrame) -> DataFrame:
    """Set blast radius and depth of methods; methods without metrics get a row of zeros."""
    m, b = metrics.alias("m"), blast.alias("b")
    zero = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0)).alias(c)
    new = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"m.{c}"), F.lit(0)).cast("int").alias(c)
    return m.join(b, F.col("m.method_id") == F.col("b.method_id"), "full_outer").select(
        F.coalesce("m.method_id", "b.method_id").alias("method_id"), zero("cognitive_complexity"), zero("lines_of_code"), zero("nesting_depth"), new("blast_radius"), new("blast_depth")
    )


def upsert_metadata(metadata: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value upsert: keys of `new` replace those of `metadata`."""
    return metadata.join(new, "key", "left_anti").unionByName(new.select("key", "value"))


def relationships(tables: GraphTables) -> DataFrame:
    """Containment and implementation edges: source_id, target_id, kind."""
    pairs = [
        tables.namespaces.select(F.col("project_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("Contains").alias("kind")),
        tables.types.select(F.col("namespace_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("Contains").alias("kind")),
        tables.methods.select(F.col("type_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("Contains").alias("kind")),
        tables.type_implements.select(F.col("type_id").alias("source_id"), F.col("interface_id").alias("target_id"), F.lit("Implements").alias("kind")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out.where("source_id is not null")


def call_edges(calls: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """Simple digraph: distinct calls without self calls; with `methods`, only those whose both ends are known."""
    out = calls.select("caller_id", "callee_id").where("caller_id <> callee_id").distinct()
    if methods is not None:
        ids = methods.select(F.col("id"))
        out = out.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").select("caller_id", "callee_id")
    return out


def find_solution(start: str) -> str:
    """The only *.sln file in `start` or its nearest parent that has any."""
    at = Path(start).resolve()
    for place in (at, *at.parents):
        found = sorted(place.glob("*.sln"))
        if len(found) == 1:
            return str(found[0])
        if found:
            raise ValueError(f"several solution files in {place}: {', '.join(f.name for f in found)}")
    raise FileNotFoundError(f"no solution file in {start} or above")


def parse_rules(text: str, defaults: list[dict]) -> list[dict]:
    """Dependency rules of a JSON document, after the defaults unless it says `includeDefaults: false`."""
    doc = json.loads(text)
    return (list(defaults) if doc.get("includeDefaults", True) else []) + list(doc.get("rules", []))


def read_rules(path: str, defaults: list[dict]) -> list[dict]:
    """parse_rules() of a file."""
    return parse_rules(Path(path).read_text(encoding="utf-8"), defaults)


def parse_zones(text: str) -> list[dict]:
    """Protected zones of a JSON document, in order."""
    return list(json.loads(text).get("zones", []))


def read_zones(path: str) -> list[dict]:
    """parse_zones() of a file; none if there is no file."""
    p = Path(path)
    return parse_zones(p.read_text(encoding="utf-8")) if p.exists() else []


def write_vector_file(path: str, vectors: DataFrame | Iterable[tuple[str, list[float]]], dims: int | None = None) -> int:
    """Vector index file: magic, version, dimensions, count, then length-prefixed ids with little-endian floats. Rows of
    a table come a partition at a time; returns how many there are."""
    rows = ((r[0], r[1]) for r in vectors.select("method_id", "vector").toLocalIterator()) if isinstance(vectors, DataFrame) else iter(vectors)
    n = 0
    with open(path, "wb") as f:
        f.write(struct.pack("<4siii", b"VECI", 1, dims or 0, 0))
        for name, vector in rows:
            dims = len(vector) if dims is None else dims
            if len(vector) != dims:
                raise ValueError(f"{name}: {len(vector)} components and not {dims}")
            raw = name.encode()
            f.write(struct.pack("<i", len(raw)) + raw + struct.pack(f"<{dims}f", *vector))
            n += 1
        f.seek(0)
        f.write(struct.pack("<4siii", b"VECI", 1, dims or 0, n))
    return n


def read_vector_file(spark: SparkSession, path: str) -> DataFrame:
    """method_id and vector of an index file, or of all in a folder; each file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                data = blob.as_buffer()
                view = memoryview(data)
                magic, version, dims, count = struct.unpack_from("<4siii", view)
                if magic != b"VECI" or version != 1:
                    raise ValueError("not a vector index file")
                at, ids, vectors = 16, [], []
                for k in range(count):
                    (n,) = struct.unpack_from("<i", view, at)
                    ids.append(bytes(view[at + 4 : at + 4 + n]).decode())
                    vectors.append(struct.unpack_from(f"<{dims}f", view, at + 4 + n))
                    at += 4 + n + 4 * dims
                    if len(ids) == 4096 or k == count - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["method_id", "vector"])
                        ids, vectors = [], []

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "method_id string, vector array<float>")
