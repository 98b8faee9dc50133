"""Shared plumbing of the training-data operators: table access, shared storage, bounded Arrow batches, whole rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callatlas.sources.scratch import materialize, release, scratch_path, shared_dir

__all__ = ["bound_arrow_batches", "bytes_of", "materialize", "packed", "read_table", "release", "salted_left_join", "scratch_path", "shared_dir"]
#: Bytes of one Arrow batch handed to a Python worker, so that very long texts cannot pile up in memory.
ARROW_BATCH_BYTES = 4 << 20
#: Rows of one Arrow batch handed to a Python worker.
ARROW_BATCH_ROWS = 2000
#: Tasks that rows of one key are spread over in joins.
SALTS = 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows; smaller session settings stay."""
    for key, most in (("maxRecordsPerBatch", ARROW_BATCH_ROWS), ("maxBytesPerBatch", ARROW_BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        given = spark.conf.get(name).rstrip("b")
        if not given.isdigit() or not 0 < int(given) <= most:
            spark.conf.set(name, str(most))


def packed(docs: DataFrame) -> DataFrame:
    """The rows of docs in one column, `row`, so that no column of theirs can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """Left join with a right side of one row for each key: its rows are repeated for each salt and the left side's rows
    spread over them, so that a key that many rows share is met in `salts` tasks."""
    salted = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    return left.withColumn("__salt", (F.monotonically_increasing_id() % salts).cast("int")).join(salted, [*keys, "__salt"], "left").drop("__salt")


def bytes_of(row: pa.StructArray, name: str) -> list[bytes | None]:
    """The UTF-8 of a text column of packed rows."""
    column = row.field(row.type.get_field_index(name))
    return (column if pa.types.is_string(column.type) else column.cast(pa.string())).cast(pa.binary()).to_pylist()
