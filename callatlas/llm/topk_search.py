"""Exact top-k inner-product search with a KD-tree per shard.

Candidates are hashed to shards of bounded size. A shard's vectors are split at medians of their dimension of greatest
spread down to leaves, every node with the tight box of its vectors. The largest possible inner product of a query with
a box bounds all vectors in it. Each query goes best first: of all nodes met so far the one with the greatest bound is
opened, bounds are computed on opening, and the search ends when no bound reaches the query's kth score. Kth scores
start from a first pass over a bounded sample of the longest vectors and go with the queries to every shard. Queries
that open the same node at the same time share its arithmetic.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callatlas.llm.common import bound_arrow_batches
from callatlas.operators.shards import Rows, against_shards, by_length

K = 5
SCALE = 256
LEAF = 256
#: Rows of the first pass at most, and components that each of them may have.
SEED_ROWS, SEED_LENGTH = 1024, 1024
#: Bound on sums that double arithmetic holds exactly.
_EXACT = float(1 << 53)
_TOP = 2**63 - 1


class KDTree:
    """Median splits with tight boxes over integer-valued rows; ids break ties."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(rows))
        low, high, self.child, self.span = [], [], [], []
        self.largest = float(np.abs(rows).max(initial=0))
        todo = [(0, len(rows), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            part = rows[order[lo:hi]]
            me = len(low)
            low.append(part.min(0))
            high.append(part.max(0))
            self.child.append([-1, -1])
            self.span.append((lo, hi))
            if parent >= 0:
                self.child[parent][side] = me
            if hi - lo > leaf and part.shape[1] and (high[me] > low[me]).any():
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(part[:, int(np.argmax(part.var(0)))], mid, kind="introselect")]
                todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.ids, self.rows = ids[order], rows[order]
        self.visited = 0  # leaves opened, counted for each query

    def bounds(self, queries: np.ndarray, node: int) -> np.ndarray:
        """The largest inner product that a vector in the node's box can have with each query."""
        return np.maximum(queries, 0) @ self.high[node] + np.minimum(queries, 0) @ self.low[node]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[float, int]]]:
        """Each query's best as a heap of at most k (score, -id), without rows of id `own`. Scores under `least`, the
        kth of an earlier pass, are left out. All queries go on a step at a time, each to its own best node; those at
        one node share its arithmetic."""
        best: list[list[tuple[float, int]]] = [[] for _ in queries]
        least = least.astype(float).copy()
        agendas = [[(-b, 0)] for b in self.bounds(queries, 0).tolist()]
        going = list(range(len(queries)))
        while going:
            at: dict[int, list[int]] = {}
            for q in going:
                agenda = agendas[q]
                if agenda and -agenda[0][0] >= least[q]:
                    at.setdefault(heapq.heappop(agenda)[1], []).append(q)
            for node, qs in at.items():
                left, right = self.child[node]
                if left >= 0:
                    for to in (left, right):
                        for q, b in zip(qs, self.bounds(queries[qs], to).tolist()):
                            if b >= least[q]:
                                heapq.heappush(agendas[q], (-b, to))
                    continue
                self.visited += len(qs)
                lo, hi = self.span[node]
                scores = queries[qs] @ self.rows[lo:hi].T
                ids = self.ids[lo:hi]
                scores[ids[None, :] == own[qs][:, None]] = -np.inf
                for q, row in zip(qs, scores):
                    near = np.flatnonzero((row >= least[q]) & (row > -np.inf))
                    if len(near) > 4 * k:
                        near = near[row[near] >= np.partition(row[near], -k)[-k]]
                    heap = best[q]
                    for s, i in zip(row[near].tolist(), (-ids[near]).tolist()):
                        if len(heap) < k:
                            heapq.heappush(heap, (s, i))
                        elif (s, i) > heap[0]:
                            heapq.heapreplace(heap, (s, i))
                    if len(heap) == k:
                        least[q] = max(least[q], heap[0][0])
            going = [q for qs in at.values() for q in qs]
        return best


def exact(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """As KDTree.search(), in integers of any size by a scan, scores held to the range of long."""
    vs = [(-i, [int(x) for x in v]) for i, v in zip(ids.tolist(), rows)]
    out = []
    for q, query in zip(own.tolist(), queries):
        ints = [int(x) for x in query]
        out.append(heapq.nlargest(k, ((max(-_TOP - 1, min(_TOP, sum(a * b for a, b in zip(ints, v)))), i) for i, v in vs if -i != q)))
    return out


def _vectors(table: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """id and scaled vector of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fit = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x):  # floor() gives a long; doubles from 2^52 on are integers already
        return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)

    return table.where(fit).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: whole(x * scale)).alias("v")).where(~F.exists("v", lambda x: F.abs(x) == float("inf")))


def _kth(asked: Rows, sample: Rows, k: int) -> dict[int, float]:
    """A kth score of each query among the sample's rows, where there are k; it bounds the true one from below."""
    out = {}
    for n, (own, qs) in asked.items():
        if n not in sample:
            continue
        ids, vs = sample[n]
        if len(ids) <= k or np.abs(vs).max(initial=0) * np.abs(qs).max(initial=0) * max(1, n) >= _EXACT:
            continue
        scores = qs @ vs.T
        scores[ids[None, :] == own[:, None]] = -np.inf
        out |= {q: s for q, s in zip(own.tolist(), np.partition(scores, -k, axis=1)[:, -k].tolist()) if s > -np.inf}
    return out


def search(table: DataFrame, is_query: str, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows; all, if there are fewer.

    Queries are the rows of `table` under the SQL condition `is_query` over vec_id. A vector is compared with those of
    as many components, floor(scale * x) each; rows with a null or non-finite component, or without an id, take no
    part. Equal scores: smaller vec_id first. Rows with the query's own id are no candidates; repeated candidate rows
    count once each, and of a query id of several vectors the least asks. Sums beyond 2^53 are formed in exact integers
    and held to the range of long. Other columns are ignored.
    """
    spark = table.sparkSession
    bound_arrow_batches(spark)
    rows = _vectors(table, id_col, vector, scale)
    queries = rows.withColumnRenamed("id", "vec_id").where(is_query).groupBy(F.col("vec_id").alias("id")).agg(F.min("v").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = rows.where(F.size("v") <= SEED_LENGTH).orderBy(F.desc(length), "id").limit(SEED_ROWS).collect()
    sample = spark.sparkContext.broadcast(by_length(np.array([r[0] for r in longest], np.int64), pa.array([r[1] for r in longest], pa.list_(pa.float64()))))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            least = _kth(by_length(ids, b.column(1)), sample.value, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([least.get(i) for i in ids.tolist()], pa.float64())], names=["id", "v", "least"])

    def index(shard: Rows) -> dict[int, tuple[KDTree, np.ndarray, np.ndarray]]:
        return {n: (KDTree(ids, vs), ids, vs) for n, (ids, vs) in shard.items()}

    def ask(trees: dict[int, tuple[KDTree, np.ndarray, np.ndarray]], asked: Rows, given: list) -> Iterator[pa.RecordBatch]:
        names, least = given[0]
        least = dict(zip(names, least.to_pylist()))
        out = []
        for n, (own, qs) in asked.items():
            if n not in trees:
                continue
            tree, ids, vs = trees[n]
            if tree.largest * float(np.abs(qs).max(initial=0)) * max(1, n) >= _EXACT:
                found = exact(qs, own, ids, vs, k)
            else:
                found = tree.search(qs, own, k, np.array([-np.inf if least[q] is None else least[q] for q in own.tolist()]))
            out += [(q, -i, int(s)) for q, heap in zip(own.tolist(), found) for s, i in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    found = against_shards(queries.mapInArrow(seed, "id long, v array<double>, least double"), rows, index, ask, "query_id long, vec_id long, score long", ["least"])
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
