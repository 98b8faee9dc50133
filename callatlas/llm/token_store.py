"""Token-id files with bit-plane shuffling.

A file row (a *segment*) holds the ids of consecutive documents in one binary value:

    magic "BPL1" | uint32 block size | uint64 ids | uint32 blocks | uint32 documents
    chunk index: blocks x 32 planes of uint32 compressed lengths (0: the plane is all zeros and not stored)
    document table, one zstandard frame: int64 doc_ids and int64 lengths, byte-shuffled
    planes, block by block, plane by plane: zstandard frames

Ids are cut into blocks of a fixed size (the last one is shorter). In a block bit k of all ids forms plane k; high
planes are mostly zeros and cost nothing. Every block can be read alone through the chunk index. All numbers are
little-endian. Segments lie in Parquet files in the shared folder, whose writer commits whole tasks only: an executor
lost half-way leaves nothing behind. Documents are range-partitioned by doc_id, so (shard, segment) is their order.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callatlas.llm.common import bound_arrow_batches, materialize

MAGIC = b"BPL1"
#: Ids of a block.
BLOCK_IDS = 1 << 15
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
#: Bytes of text that one shard aims at.
SHARD_BYTES = 32 << 20
#: Shards whose sizes are summed together, and shards whose starts are broadcast at most (16 bytes each).
GROUP, BROADCAST_SHARDS = 4096, 500_000
#: Distinct words that a Python worker keeps ids of.
CACHE_WORDS = 400_000
END_ID = 2
_PLANES = 32
_HEAD = struct.Struct("<4sIQII")


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK_IDS, level: int = 1) -> bytes:
    """One segment: int64 doc_ids and lengths of documents, uint32 ids of all of them in order."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    n_blocks = -(-len(ids) // block)
    index = np.zeros((n_blocks, _PLANES), "<u4")
    planes: list[bytes] = []
    for k in range(n_blocks):
        part = np.ascontiguousarray(ids[k * block : (k + 1) * block], "<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")  # row: bits 0..31 of an id
        width = int(part.max()).bit_length() if len(part) else 0
        rows = np.packbits(bits[:, :width].T, axis=1, bitorder="little")
        for p in range(width):
            if rows[p].any():
                z = squeeze(rows[p].tobytes())
                index[k, p] = len(z)
                planes.append(z)
    table = squeeze(np.concatenate([doc_ids, lengths]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())
    return b"".join([_HEAD.pack(MAGIC, block, len(ids), n_blocks, len(doc_ids)), index.tobytes(), struct.pack("<I", len(table)), table, *planes])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment."""
    magic, block, n, n_blocks, n_docs = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    expand = zstandard.ZstdDecompressor().decompress
    at = _HEAD.size
    index = np.frombuffer(blob, "<u4", n_blocks * _PLANES, at).reshape(n_blocks, _PLANES)
    at += index.nbytes
    (size,) = struct.unpack_from("<I", blob, at)
    table = np.frombuffer(expand(blob[at + 4 : at + 4 + size]), np.uint8)
    docs = np.ascontiguousarray(table.reshape(8, 2 * n_docs).T).view("<i8").ravel()
    at += 4 + size
    ids = np.zeros(n, "<u4")
    for k in range(n_blocks):
        m = min(block, n - k * block)
        rows = np.zeros((_PLANES, -(-m // 8)), np.uint8)
        for p in np.flatnonzero(index[k]):
            z = int(index[k, p])
            rows[p] = np.frombuffer(expand(blob[at : at + z]), np.uint8)
            at += z
        bits = np.unpackbits(rows, axis=1, bitorder="little")[:, :m]
        ids[k * block : k * block + m] = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()
    return docs[:n_docs], docs[n_docs:], ids


class WordTokens(dict):
    """Ids of words, filled by the tokenizers library's model as asked for; at most CACHE_WORDS of them."""

    def __init__(self, model, to_model):
        super().__init__()
        self.model, self.to_model = model, to_model

    def __missing__(self, word: str) -> bytes:
        ids = np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.to_model))], "<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Whole texts to ids as the tokenizers library gives them.

    For a lower-casing word-level splitter over Latin text the library's pre-tokens are found with one regular
    expression and its model encodes each distinct one once. A text with any other character, or with what may be a
    special token, goes through the library as a whole; so does every text under any other kind of tokenizer.
    """

    def __init__(self, path: str):
        import json
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_chars = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}  # the public byte-to-character rule of byte-level BPE
        self.words = WordTokens(self.library.model, byte_chars)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or []) or "(?!)", re.IGNORECASE)
        #: Characters whose case, class and normal form this module and the library surely agree on.
        self.plain = re.compile("[\t\n\r -~¡-©«-±´¶-¸»¿À-ÖØ-öø-ÿ×÷Œœ‘-”–—…€]*")
        self.cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\\sa-zß-öø-ÿœ0-9]+")
        self.fast = self._splits_words(spec)

    @staticmethod
    def _splits_words(spec: dict) -> bool:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        pattern = steps[0].get("pattern", {}).get("Regex") if steps else None
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        out: list[bytes | None] = [None] * len(texts)
        get, cut = self.words.__getitem__, self.cut.findall
        for k, t in enumerate(texts):
            if self.fast and self.plain.fullmatch(t) and not ("<" in t and self.special.search(t)):
                out[k] = b"".join(map(get, cut(t.lower())))
            else:  # one by one: the library's encodings hold hundreds of bytes a token
                out[k] = np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


SEGMENT_SCHEMA = "shard int, segment long, start long, n_ids long, blob binary"


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Encode documents in ascending doc_id order and write their segments to `path`.

    Null texts count as empty: they hold the end id only. Rows without a doc_id come first; rows of equal ids follow
    each other in the order of their texts. An empty table gives no segment.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_chars = (docs.agg(F.expr("sum(try_cast(n_chars as double))")) if "n_chars" in docs.columns else rows.agg(F.sum(F.length("text")))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_chars) // SHARD_BYTES))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, start, held
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            null = np.iinfo(np.int64).min  # stands for a missing doc_id
            blob = pack(np.array([null if n is None else n for n in names], np.int64), lengths, np.frombuffer(b"".join(parts), "<u4"))
            row = [pa.array([shard], pa.int32()), pa.array([segment], pa.int64()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())]
            segment, start, held = segment + 1, start + held, 0
            names.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(row, names=["shard", "segment", "start", "n_ids", "blob"])

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1).to_pylist())):
                names.append(name)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= SEGMENT_IDS:
                    yield close()
        if names:
            yield close()

    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32) of every document in the files."""
    return _read(spark, path, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())


def _starts(segments: DataFrame) -> DataFrame:
    """shard and `base`, the ids of all shards before it. Shards are summed in groups of GROUP; only the groups' sums
    pass the driver, one for GROUP shards, and each group is numbered by itself."""
    totals = materialize(segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("g", (F.col("shard") / GROUP).cast("int")), "shard-sizes")
    before, at = {}, 0
    for g, n in totals.groupBy("g").agg(F.sum("n")).orderBy("g").collect():
        before[g] = at
        at += n
    base = totals.sparkSession.createDataFrame(list(before.items()), "g int, before long")
    inside = F.sum("n").over(W.partitionBy("g").orderBy("shard")) - F.col("n")
    return totals.withColumn("inside", inside).join(F.broadcast(base), "g").select("shard", (F.col("before") + F.col("inside")).alias("base"))


def _read(spark: SparkSession, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    bound_arrow_batches(spark)
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    starts = materialize(_starts(segments.select("shard", "n_ids")), "shard-starts")
    placed = segments.join(F.broadcast(starts) if starts.count() <= BROADCAST_SHARDS else starts, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                docs, lengths, ids = unpack(b.column(1)[k].as_py())
                starts = np.cumsum(lengths) - lengths
                values = [value(ids[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist())]
                doc_id = pa.array(docs, mask=docs == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(starts + b.column(0)[k].as_py()), pa.array(lengths), pa.array(values, kind)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    return placed.select((F.col("base") + F.col("start")).alias("start"), "blob").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
