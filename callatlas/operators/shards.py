"""Queries against shards of candidates: every query meets every candidate, neither side is ever gathered in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of the vectors of a shard, on the average: 64 MB of doubles.
SHARD_VALUES = 8 << 20
#: Fewer rows don't make a shard of their own.
LEAST_ROWS = 512
#: Queries that a shard answers at a time.
QUERY_ROWS = 1024

Rows = dict[int, tuple[np.ndarray, np.ndarray]]


def by_length(ids: np.ndarray, vectors: pa.ListArray) -> Rows:
    """Ids and rows apart by their number of components."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out: Rows = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = (ids[at], flat[starts[at][:, None] + np.arange(n)].astype(np.float64).reshape(len(at), n))
    return out


def joined(parts: list[Rows]) -> Rows:
    return {n: tuple(np.concatenate([p[n][k] for p in parts if n in p]) for k in (0, 1)) for n in {n for p in parts for n in p}}


def against_shards(queries: DataFrame, candidates: DataFrame, index: Callable[[Rows], Any], ask: Callable[[Any, Rows, list], Iterator[pa.RecordBatch]], schema: str, extra: list[str] | None = None) -> DataFrame:
    """ask(index(shard's rows), block of queries, their `extra` columns) for every shard and block.

    Both tables hold `id` and `v` (array<double>), the queries also the columns `extra`. Candidates go to shards by a
    hash of their ids, queries to all of them; in a shard the candidates come first, then the queries stream past in
    blocks. A task holds one shard and one block; each table is read once and nothing passes the driver but counts."""
    extra = extra or []
    spark = candidates.sparkSession
    n, values = candidates.agg(F.count("*"), F.sum(F.size("v"))).first()
    shards = max(1, -(-(values or 0) // SHARD_VALUES), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    given = [f for f in queries.schema if f.name in extra]
    mine = candidates.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("side"), "id", "v", *[F.lit(None).cast(f.dataType).alias(f.name) for f in given])
    theirs = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), "id", "v", *[f.name for f in given])
    both = mine.union(theirs).repartitionById(shards, F.col("shard")).sortWithinPartitions("side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        made = None
        for b in batches:
            first = int(pc.sum(pc.equal(b.column(1), 0)).as_py() or 0)
            ids = _ids(b.column(2))
            if first:
                held.append(by_length(ids[:first], b.column(3).slice(0, first)))
            for at in range(first, b.num_rows, QUERY_ROWS):
                if made is None:
                    made = index(joined(held))
                    held.clear()
                part = b.slice(at, QUERY_ROWS)
                yield from ask(made, by_length(ids[at : at + QUERY_ROWS], part.column(3)), [(part.column(2).to_pylist(), part.column(4 + k)) for k in range(len(given))])

    return both.mapInArrow(run, schema)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), object) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
