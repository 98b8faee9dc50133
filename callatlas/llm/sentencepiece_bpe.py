"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut where no vocabulary piece holds the two neighbouring characters side by side: no merge can ever
cross such a place, so the segments are independent. Each distinct segment is encoded once with a score-ordered
agenda of adjacent symbol pairs (best score first, then leftmost), characters outside the vocabulary fall back to
bytes, and the ids of a text are its segments' ids in order. Every newly encoded segment of an Arrow batch is
compared with the sentencepiece library before its ids are used; the library decodes the ids of each whole text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callatlas.llm.common import bound_arrow_batches

SPACE = "▁"
#: A score below any pair's.
NEVER = float("inf")
#: Segments of up to so many symbols keep their agenda in a list, longer ones in a heap.
SHORT = 24
#: Distinct segments that a Python worker keeps; bounds its memory at about 100 MB.
CACHE_SEGMENTS = 400_000
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class MergeVocabulary:
    """Pieces, scores and byte pieces of a merge-type model file, with the agenda encoder over them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.piece_id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.unk = sp.unk_id()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[piece] = -sp.get_score(i)
                self.piece_id[piece] = i
        self.has_bytes = any(self.byte_id)
        self.code = "H" if sp.get_piece_size() < 65536 else "I"
        #: Texts go through the library's normalizer as wholes if the model rewrites characters.
        self.whole = sp.normalize("a  b\tﬁ ") != f"{SPACE}a{SPACE}{SPACE}b\tﬁ{SPACE}"
        self.lone_feed = not any("\n" in p for p in self.rank)
        self.cutter = self._cutter()
        self.words = WordIds(self)

    def _cutter(self) -> re.Pattern:
        """Runs of Latin letters with the space marks before them, and runs of anything else. A place is cut only if
        no piece holds its two sides next to each other; vocabularies with such pieces are cut less or not at all."""
        letter = "[A-Za-zÀ-ÖØ-öø-ɏ]"
        other = f"(?:(?!{letter}|{SPACE})(?s:.))"
        if any(re.search(f"(?s)[^{SPACE}]{SPACE}", p) for p in self.rank):
            return re.compile("(?s).+")
        if any(re.search(f"{letter}{other}|{other}{letter}", p) for p in self.rank):
            return re.compile(f"(?s){SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(f"{SPACE}*{letter}+|{SPACE}*{other}+|{SPACE}+")

    def agenda(self, text: str) -> list[str]:
        """Symbols of `text` after all merges: the best-scored adjacent pair first, the leftmost among equals."""
        if len(text) > SHORT:
            return self._long_agenda(text)
        symbols = list(text)
        score = self.rank.get
        ahead = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while ahead:
            best = min(ahead)
            if best == NEVER:
                break
            i = ahead.index(best)
            merged = symbols[i] + symbols.pop(i + 1)
            symbols[i] = merged
            del ahead[i]
            if i:
                ahead[i - 1] = score(symbols[i - 1] + merged, NEVER)
            if i < len(ahead):
                ahead[i] = score(merged + symbols[i + 1], NEVER)
        return symbols

    def _long_agenda(self, text: str) -> list[str]:
        """agenda() with a heap and linked neighbours, for segments of any length."""
        symbols = list(text)
        n = len(symbols)
        rank = self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, pair) for i, pair in enumerate(map("".join, zip(symbols, symbols[1:]))) if (r := rank(pair)) is not None]
        heapify(heap)
        while heap:
            _, i, merged = heappop(heap)
            left = symbols[i]
            j = after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != len(merged) or left + symbols[j] != merged:
                continue  # one of the two has been merged elsewhere since
            symbols[i], symbols[j] = merged, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = merged + symbols[k]
                if (r := rank(pair)) is not None:
                    heappush(heap, (r, i, pair))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + merged
                if (r := rank(pair)) is not None:
                    heappush(heap, (r, h, pair))
        return [s for s in symbols if s]

    def segment_ids(self, segment: str) -> list[int]:
        ids: list[int] = []
        known = self.piece_id.get
        for s in self.agenda(segment):
            if (i := known(s)) is not None:
                ids.append(i)
            elif self.has_bytes:
                ids.extend(self.byte_id[b] for b in s.encode("utf-8", "replace"))
            elif not ids or ids[-1] != self.unk:
                ids.append(self.unk)
        return ids

    def check(self, segments: list[str], ours: list[list[int]]) -> None:
        """Compare segments' ids with the library's. It puts a space mark before every text, so a segment that
        begins with one is given without it, and any other stands behind a line feed, which merges with nothing."""
        head = self.library.encode("\n") if self.lone_feed else []
        given, skip = [], []
        for s in segments:
            behind = not (s.startswith(SPACE) and s.strip(SPACE))
            given.append(("\n" + s if behind else s[1:]).replace(SPACE, " "))
            skip.append(len(head) if behind else 0)
        for s, mine, found, n in zip(segments, ours, self.library.encode(given, num_threads=1), skip, strict=True):
            if (n or self.lone_feed or s.strip(SPACE)) and mine != found[n:]:
                raise ValueError(f"agenda and library differ on {s!r}: {mine} and {found[n:]}")

    def encode_batch(self, texts: list[str]) -> list[array]:
        """Ids of whole texts. What an earlier batch has not seen is encoded and then compared with the library."""
        get, code = self.words.__getitem__, self.code
        out = []
        for text in texts:
            ids = array(code)
            if not text:
                pass
            elif self.whole:
                ids.frombytes(self.words.of(self.library.normalize(text)))
            elif "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
                ids.frombytes(self.words.of(SPACE + text.replace(" ", SPACE)))
            else:
                ids.frombytes(b"".join(map(get, text.split(" "))))
            out.append(ids)
        self.words.settle()
        return out

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """The library's decoding of each list of ids."""
        return self.library.decode(ids, num_threads=1) if ids else []


class WordIds(dict):
    """Ids, as machine integers, of what stands between two spaces, its space mark before it; filled as asked for.

    Holds at most CACHE_SEGMENTS words and segments each, then starts afresh. settle() compares the new segments
    with the library.
    """

    def __init__(self, vocab: MergeVocabulary):
        super().__init__()
        self.vocab, self.segments, self.new = vocab, {}, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.of(SPACE + word)
        if len(self) >= CACHE_SEGMENTS:
            self.clear()
        self[word] = ids
        return ids

    def of(self, marked: str) -> bytes:
        vocab, out = self.vocab, []
        for s in vocab.cutter.findall(marked):
            ids = self.segments.get(s)
            if ids is None:
                plain = self.new[s] = vocab.segment_ids(s)
                ids = array(vocab.code, plain).tobytes()
                if len(self.segments) >= CACHE_SEGMENTS:
                    self.segments.clear()
                self.segments[s] = ids
            out.append(ids)
        return b"".join(out)

    def settle(self) -> None:
        self.vocab.check(list(self.new), list(self.new.values()))
        self.new.clear()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> MergeVocabulary:
    """One per Python worker and model file; workers are reused between tasks."""
    return MergeVocabulary(path)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids (little-endian uint32) and decoded text of each document; a null text counts as empty.

    One row per input row, in any order; an empty text has no ids and decodes to the empty text. Repeated rows and
    null ids are kept, columns other than doc_id and text are ignored.
    """
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for b in batches:
            ids = vocab.encode_batch(_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([array("I", i).tobytes() for i in ids], pa.binary()), pa.array(vocab.decode_batch([i.tolist() for i in ids]), pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As encode(), with SHA-256 digests of the comma-joined ids and of the decoded text instead of these themselves."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        names = [str(i).encode() for i in range(vocab.library.get_piece_size())]
        for b in batches:
            ids = [i.tolist() for i in vocab.encode_batch(_texts(b.column(1)))]
            rows = (
                [len(i) for i in ids],
                [hashlib.sha256(b",".join(map(names.__getitem__, i))).hexdigest() for i in ids],
                [hashlib.sha256(t.encode()).hexdigest() for t in vocab.decode_batch(ids)],
            )
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST_SCHEMA)
