"""Embedding engines behind one protocol, an index of vectors, and a cache of indexes by store."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callatlas.operators import similarity as S

#: Texts of one remote request, tries of one, size of the model's vocabulary.
REMOTE_BATCH, TRIES, VOCABULARY = 100, 3, 30_522


class EmbeddingEngine(Protocol):
    """Turns texts (method_id, text) into vectors (method_id, vector array<float>), and says what it is."""

    name: str
    dims: int

    def embed(self, texts: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class HashEngine:
    """Signed feature hashing of words and word pairs; needs nothing. Texts without words have no vector."""

    dims: int = S.DIMS
    name: str = "hash"

    def embed(self, texts: DataFrame) -> DataFrame:
        return S.dense(S.hash_embedding(texts, "method_id", "text", self.dims), self.dims)


def _in_batches(texts: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], size: int) -> DataFrame:
    """Vectors from make()'s function, set up once per task, over batches of `size` texts in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = None
        for b in batches:
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                embed = embed or make()
                rows = np.asarray(embed([t or "" for t in part.column(1).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(rows), pa.list_(pa.float32()))], names=["method_id", "vector"])

    return texts.select(F.col("method_id").cast("string").alias("method_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "method_id string, vector array<float>")


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def word_ids(text: str, vocabulary: int = VOCABULARY) -> list[int]:
    """Numbers of a text's words by a hash that is the same in every process."""
    return [int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "little") % vocabulary for w in text.lower().split()]


@dataclass(frozen=True)
class ModelEngine:
    """A model over word numbers: make_session() gives, once per task, a function from a list of numbers to a row of
    states for each; their mean at unit length is the vector."""

    make_session: Callable[[], Callable[[list[int]], np.ndarray]]
    dims: int = 384
    name: str = "model"

    def embed(self, texts: DataFrame) -> DataFrame:
        make_session, dims = self.make_session, self.dims

        def make():
            session = make_session()
            return lambda part: unit_rows(np.array([np.asarray(session(ids)).mean(0) if (ids := word_ids(t)) else np.zeros(dims) for t in part], float).reshape(-1, dims))

        return _in_batches(texts, make, 64)


def onnx_session(path: str) -> Callable[[], Callable[[list[int]], np.ndarray]]:
    """A maker of sessions of a model file for ModelEngine."""

    def make():
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        names = [i.name for i in session.get_inputs()]

        def states(ids: list[int]) -> np.ndarray:
            given = {"input_ids": np.array([ids], np.int64), "attention_mask": np.ones((1, len(ids)), np.int64), "token_type_ids": np.zeros((1, len(ids)), np.int64)}
            return session.run(None, {n: given[n] for n in names if n in given})[0][0]

        return states

    return make


class Busy(Exception):
    """A remote service asks to come again later."""


@dataclass(frozen=True)
class RemoteEngine:
    """A service: make_client() gives, once per task, a function from texts to (place, vector) pairs in any order. Texts
    go in requests of REMOTE_BATCH; a request that fails is tried TRIES times in all, after 1, 2, 4, ... times `wait`."""

    make_client: Callable[[], Callable[[list[str]], list[tuple[int, list[float]]]]]
    dims: int = 1536
    wait: float = 1.0
    name: str = "remote"

    def embed(self, texts: DataFrame) -> DataFrame:
        make_client, wait = self.make_client, self.wait

        def make():
            client = make_client()

            def ask(part: list[str]) -> np.ndarray:
                for k in range(TRIES):
                    try:
                        return np.array([v for _, v in sorted(client(part), key=lambda x: x[0])])
                    except (Busy, OSError):
                        if k == TRIES - 1:
                            raise
                        time.sleep(wait * 2**k)

            return ask

        return _in_batches(texts, make, REMOTE_BATCH)


def engine(kind: str = "hash", dims: int | None = None, model_path: str | None = None, make_client=None) -> EmbeddingEngine:
    """The engine of a kind (hash, model, remote); hash where its model file or client is not there."""
    if kind not in ("hash", "model", "remote"):
        raise ValueError("engine is one of hash, model, remote")
    sized = {} if dims is None else {"dims": dims}
    if kind == "model" and model_path and os.path.exists(model_path):
        return ModelEngine(onnx_session(model_path), **sized)
    if kind == "remote" and make_client is not None:
        return RemoteEngine(make_client, **sized)
    return HashEngine(**sized)


class VectorIndex:
    """Vectors of one length by method, to be added to and searched. A table throughout: nothing is gathered."""

    def __init__(self, vectors: DataFrame, dims: int | None = None):
        self.dims = dims
        self.vectors = S.check_vectors(vectors.select("method_id", "vector"), dims)

    def add(self, vectors: DataFrame) -> VectorIndex:
        """With more vectors; those of a known method take the place of the old ones."""
        new = S.check_vectors(vectors.select("method_id", "vector"), self.dims)
        out = VectorIndex.__new__(VectorIndex)
        out.dims, out.vectors = self.dims, self.vectors.join(new.select("method_id"), "method_id", "left_anti").select("method_id", "vector").union(new)
        return out

    def search(self, query: list[float], k: int = 10) -> DataFrame:
        return S.top_k(self.vectors, query, k)


class IndexCache:
    """Indexes by store, kept in Spark's cache until they are dropped or the store is another."""

    def __init__(self) -> None:
        self.held: dict[str, VectorIndex] = {}

    def get(self, store: str, make: Callable[[], DataFrame]) -> VectorIndex:
        if store not in self.held:
            self.held[store] = VectorIndex(make().persist())
        return self.held[store]

    def drop(self, store: str) -> None:
        if found := self.held.pop(store, None):
            found.vectors.unpersist()


def semantic_search(spark: SparkSession, vectors: DataFrame, query: str, made_by: EmbeddingEngine | None = None, k: int = 10) -> DataFrame:
    """method_id and score of the k methods nearest a text, by the engine that made the vectors; none for a text
    without a vector."""
    asked = (made_by or HashEngine()).embed(spark.createDataFrame([("query", query)], "method_id string, text string")).first()
    return S.top_k(vectors, asked[1], k) if asked else vectors.select("method_id", F.lit(0.0).alias("score")).limit(0)
