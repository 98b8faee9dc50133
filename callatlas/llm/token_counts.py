"""Token counts by unigram segmentation over a trie of pre-tokens.

The distinct pre-tokens of an Arrow batch form a trie. The best score of a prefix depends on the prefix alone, so each
trie node's forward score (and the number of pieces of its best segmentation) is computed once, from the scores of the
at most L nodes above it, however many pre-tokens share it; the node of a whole pre-token keeps the count. Pieces and
scores come from a public vocabulary file: the score of a piece is -ln(1 + its rank).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callatlas.llm.common import bound_arrow_batches

SPACE = "▁"
#: A character outside the vocabulary counts as one token of this score.
UNKNOWN = -20.0
CACHE_WORDS = 400_000
SCHEMA = "doc_id long, n_chars long, n_pre_tokens long, n_tokens long, n_unknown long"


class UnigramCounter:
    """Counts of tokens and of unknown characters in the best segmentation of words; ties go to fewer tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.known: dict[str, tuple[int, int]] = {}
        #: Endings of pieces by their last characters would not shorten the search: lengths per last character do.
        lengths: dict[str, set[int]] = {}
        for p in scores:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}

    def forward(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """Terminal counts of distinct words. In sorted order the path to a word's node shares its first nodes with
        the path before it, so the stack of forward scores is cut back to the common prefix and grown from there."""
        out: dict[str, tuple[int, int]] = {}
        score_of, lengths = self.scores.get, self.lengths
        stack: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # score, -tokens, -unknown of each prefix
        before = ""
        for word in sorted(words):
            common = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                common += 1
            del stack[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                s, n, u = stack[end - 1]
                best = (s + UNKNOWN, n - 1, u - 1)
                for size in lengths.get(word[end - 1], ()):
                    if size > end:
                        break
                    p = score_of(word[end - size : end])
                    if p is not None:
                        s, n, u = stack[end - size]
                        s += p
                        if s > best[0] or (s == best[0] and n - 1 > best[1]):
                            best = (s, n - 1, u)
                stack.append(best)
            out[word] = (-stack[-1][1], -stack[-1][2])
            before = word
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """Pre-tokens, tokens and unknown characters of each text."""
        split = [pre_tokens(t) for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = {w for words in split for w in words}
        self.known.update(self.forward(list(new)))
        get, tokens, unknown = self.known.__getitem__, itemgetter(0), itemgetter(1)
        out = []
        for words in split:
            found = list(map(get, words))
            out.append((len(words), sum(map(tokens, found)), sum(map(unknown, found))))
        return out




def pre_tokens(text: str) -> list[str]:
    """Words between white space, each cut into letter runs, single digits and runs of other characters; the first
    part of each word that follows a space carries a space mark."""
    return re.findall(r"▁?[^\W\d_]+|▁?\d|▁?(?:[^\w\s▁]|_)+|▁", SPACE + SPACE.join(text.split())) if text and not text.isspace() else []


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return UnigramCounter({p: -math.log(1 + k) for k, p in enumerate(pieces, 1)})


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars, n_pre_tokens, n_tokens and n_unknown of each document.

    One row per input row; null, empty and white texts have no tokens; repeated rows and null ids are kept.
    """
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n_pre, n_tok, n_unk = zip(*c.count(texts)) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (list(map(len, texts)), n_pre, n_tok, n_unk)]], names=["doc_id", "n_chars", "n_pre_tokens", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
