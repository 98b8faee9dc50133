"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Benchmark items are cut into windows of WINDOW consecutive words (an item of fewer words is one window). Windows of
one length form a search: a table over hashed blocks of two words holds how far a window's end may be moved without
missing an occurrence, a position that may not be moved selects its test strings from a bucket by the hash of its last
words, and each test string is compared word by word. A whole Arrow batch is searched at once: its words are cut into
lanes, every lane moves its own window end by its own shift, and all lanes step together. The tables of a block of
items are built once and broadcast as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callatlas.llm.common import bound_arrow_batches, bytes_of, materialize, packed, release

WINDOW = 10
#: Benchmark text that one pass over the documents searches for; larger benchmarks take several passes.
ITEM_BLOCK_BYTES = 4 << 20
#: Words of a suffix that select the bucket.
SUFFIX = 4
_SHIFT_BITS = 20
_LANES = 2048
#: Bytes outside words become spaces and A-Z become a-z; all bytes of non-ASCII characters belong to words.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8: runs of ASCII digits and letters and of any other characters above ASCII."""
    return text.translate(WORD_BYTES).split() if text else []


def _mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in wrapping arithmetic."""
    a = a.astype(np.uint64)
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(29))


def _block(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Table position of the block of two words."""
    return (_mix(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)) >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)


def _suffix(rows: np.ndarray) -> np.ndarray:
    """Hash of each row's words."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = _mix(h * np.uint64(31) + rows[:, k].astype(np.uint64) + np.uint64(1))
    return h


class WindowSearch:
    """Wu-Manber tables for windows of one length over word numbers from 1; 0 is any word of no window."""

    def __init__(self, windows: np.ndarray):
        """From distinct windows, one in each row; they are put in another order."""
        self.windows = windows
        self.length = m = windows.shape[1]
        self.block = 2 if m > 1 else 1
        self.shift = np.full(1 << _SHIFT_BITS, m - self.block + 1, np.int32)
        for end in range(self.block - 1, m):  # the last block comes last, so the smallest shift stays
            at = _block(self.windows[:, end - 1] if self.block == 2 else np.zeros(len(self.windows)), self.windows[:, end])
            self.shift[at] = np.minimum(self.shift[at], m - 1 - end)
        self.n_suffix = min(SUFFIX, m)
        keys = _suffix(self.windows[:, m - self.n_suffix :])
        self.order = order = np.argsort(keys, kind="stable")
        self.windows = self.windows[order]
        self.keys, self.starts, self.counts = np.unique(keys[order], return_index=True, return_counts=True)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Window ends that the shift table can't skip."""
        m, n = self.length, len(words)
        if n < m:
            return np.empty(0, np.int64)
        before = np.concatenate([np.zeros(1, words.dtype), words[:-1]]) if self.block == 2 else np.zeros(n, words.dtype)
        step = max(m, -(-n // _LANES))
        at = np.arange(m - 1, n, step)
        stop = np.minimum(at + step, n)
        found = []
        while len(at):
            s = self.shift[_block(before[at], words[at])]
            found.append(at[s == 0])
            at = at + np.maximum(s, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window ends and the numbers of the windows that occur there."""
        m = self.length
        ends = self.candidates(words)
        if not len(ends):
            return ends, ends
        keys = _suffix(words[ends[:, None] + np.arange(1 - self.n_suffix, 1)])
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[slot] == keys
        ends, slot = ends[hit], slot[hit]
        sizes = self.counts[slot]
        ends = np.repeat(ends, sizes)
        tests = np.repeat(self.starts[slot] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(ends))
        same = np.ones(len(ends), bool)
        for k in range(m):
            same &= words[ends - (m - 1 - k)] == self.windows[tests, k]
        return ends[same], tests[same]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and, for each row, which of them it is."""
    order = np.lexsort(rows.T[::-1])
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order][1:] != rows[order][:-1]).any(1)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return rows[order][new], which


class ItemBlock:
    """Searches for all windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            numbers = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.int32)
            if len(numbers):
                m = min(window, len(numbers))
                by_length.setdefault(m, []).append((place[item], np.lib.stride_tricks.sliding_window_view(numbers, m)))
        self.searches = []
        for m, parts in sorted(by_length.items()):
            windows, which = _distinct(np.concatenate([w for _, w in parts]))
            pairs = np.unique(np.stack([which, np.repeat([i for i, _ in parts], [len(w) for _, w in parts])]), axis=1)
            s = WindowSearch(windows)
            sizes = np.bincount(pairs[0], minlength=len(windows))
            starts = np.cumsum(sizes) - sizes
            order = s.order
            owners = pairs[1][np.repeat(starts[order] - np.cumsum(sizes[order]) + sizes[order], sizes[order]) + np.arange(len(pairs[1]))]
            self.searches.append((s, owners, np.concatenate([[0], np.cumsum(sizes[order])])))

    def search(self, texts: list[bytes | None]) -> tuple[list[int], list[np.ndarray], list[list[int]]]:
        """Per text: number of words, whether each word is hit, ids of the items with an occurring window."""
        split = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        gap = 1  # a word of no window between texts
        offsets = np.concatenate([[0], np.cumsum(sizes + gap)])
        words = np.zeros(offsets[-1], np.int32)
        get = self.number.get
        for o, w in zip(offsets.tolist(), split):
            if w:
                words[o : o + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
        edges = np.zeros(len(words) + 1, np.int32)
        owner, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, of, starts in self.searches:
            ends, tests = s.search(words)
            if len(ends):
                np.add.at(edges, ends - s.length + 1, 1)
                np.add.at(edges, ends + 1, -1)
                sizes_of = starts[tests + 1] - starts[tests]
                rows = np.repeat(np.searchsorted(offsets, ends, "right") - 1, sizes_of)
                items.append(of[np.repeat(starts[tests] - np.cumsum(sizes_of) + sizes_of, sizes_of) + np.arange(len(rows))])
                owner.append(rows)
        hit = np.cumsum(edges[:-1]) > 0
        pairs = np.unique(np.concatenate(owner) * max(1, len(self.ids)) + np.concatenate(items))
        found: list[list[int]] = [[] for _ in texts]
        for p in pairs.tolist():
            found[p // len(self.ids)].append(self.ids[p % len(self.ids)])
        return sizes.tolist(), [hit[o : o + n] for o, n in zip(offsets.tolist(), sizes.tolist())], found


def _blocks(items: DataFrame, block_bytes: int) -> list[list[int]] | None:
    """Blocks of at most `block_bytes` of text (or a single item) as lists of buckets of a hash of the rows, and None if
    one block holds all. Buckets are made finer until each one fits; only their sizes are gathered."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        return None
    n = 4 * -(-total // block_bytes)
    while True:
        sizes = items.groupBy(_bucket(n).alias("k")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct("item_id", "text").alias("rows")).orderBy("k").collect()
        if all(r["bytes"] <= block_bytes or r["rows"] == 1 for r in sizes):
            break
        n *= 2
    blocks, room = [[]], block_bytes
    for r in sizes:
        if blocks[-1] and r["bytes"] > room:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(r["k"])
        room -= r["bytes"]
    return [[n, *b] for b in blocks]


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(n))


def _passes(state: DataFrame, docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, texts) -> DataFrame:
    """Run every block of items over `state`, whose last four columns hold what was found so far: n_words, n_hit, hit
    (bits of the hit words, between passes) and items; `texts` takes the texts from a batch's first column. Each pass
    adds to the hit words and items of the passes before it, without any shuffle; several passes write their rows."""
    bound_arrow_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = _blocks(items, block_bytes)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    several, passed = blocks is not None, None
    for k, block in enumerate(blocks or [None]):
        part = items if block is None else items.where(_bucket(block[0]).isin(block[1:]))
        found = [(r[0], bytes(r[1])) for r in part.select("item_id", F.col("text").cast("binary")).distinct().collect()]
        shared = docs.sparkSession.sparkContext.broadcast(ItemBlock(found, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = shared.value
            for b in batches:
                *rest, _, _, bits, items = b.columns
                sizes, hits, found = search.search(texts(b.column(0)))
                if several:
                    hits = [h if x is None else h | (np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) > 0) for h, x in zip(hits, bits.to_pylist())]
                    found = [x + y for x, y in zip(found, items.to_pylist())]
                bits = pa.array([np.packbits(h).tobytes() if several else None for h in hits], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64()), pa.array([int(h.sum()) for h in hits], pa.int64()), bits, pa.array(found, pa.list_(pa.int64()))], names=b.schema.names)

        state = state.mapInArrow(run, schema)
        if several and k < len(blocks) - 1:  # a stage holds the tables of one block only
            before, passed = passed, materialize(state, "decontamination-pass")
            state = passed
            if before is not None:
                release(before)
    return state


def _nothing_yet() -> list[Column]:
    return [F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("hit"), F.expr("cast(array() as array<long>)").alias("items")]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """doc_id with n_words, n_hit and the array of occurring item ids, `items`.

    One row per input row; other columns are ignored. Null and empty texts have no words; null item ids or texts and
    items without words never occur; an item id of several rows occurs if any of them does; repeated rows count once.
    Each pass holds at most `block_bytes` of benchmark text (or one item).
    """
    state = docs.select(F.col("text").cast("string").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *_nothing_yet())
    found = _passes(state, docs, benchmark, window, block_bytes, lambda column: column.to_pylist())
    return found.select("doc_id", "n_words", "n_hit", F.array_distinct("items").alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """scan()'s rows with the items as a count and a SHA-256 over their ids, sorted as strings and comma-joined."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns whatever their names, that no benchmark window occurs in; as scan() otherwise."""
    state = packed(docs).select("row", *_nothing_yet())
    found = _passes(state, docs, benchmark, window, block_bytes, lambda column: bytes_of(column, "text"))
    return found.where("n_hit = 0").select("row.*")
