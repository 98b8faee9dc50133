"""Toxic spans with a linear-chain conditional random field, and document scores from its marginals.

Token labels come from document labels. First, in a toxic document the tokens with a feature (the word, its first
letters) that toxic documents hold far more often than others are toxic and all other tokens are not; the two-state
chain is trained on these tags. Then the tags are estimated anew in each round by constrained expectation
maximization: a toxic document has at least one toxic token, any other has none, and expected tags and steps given that
take the place of the first ones. Forward-backward gives each token's marginal, exactly for texts of any length; a
document's score is a logistic function of their sum, maximum and density, its offending spans are runs of tokens whose
marginal is at least 0.5.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callatlas.llm.common import bound_arrow_batches, bytes_of, materialize, packed
from callatlas.llm.decontaminate import words_of
from callatlas.llm.linear import Logistic, sigmoid

#: Labelled documents that the model is fitted to at most: the first by a hash of their ids.
TRAIN_DOCS = 16_000
#: Of these, documents that the chain's weights are trained on, at most; half of them toxic if there are as many.
CHAIN_DOCS = 2_000
#: Words that these documents have together at most; a document that would go over it is passed by, the next is tried.
CHAIN_WORDS = 4_000_000
#: Padded tokens that training, and scoring, hold messages of at a time.
CHAIN_CELLS, CELLS = 200_000, 1_000_000
#: Toxic documents that a feature needs, and its least log odds.
MIN_DOCS, MIN_LOG_ODDS = 4, 2.5
#: Tokens of a lane. Lanes of one text go in lock-step; what crosses their borders is carried exactly.
LANE = 1024
#: Rounds of training on the first tags, and on expected ones.
SEED_ROUNDS, EM_ROUNDS = 60, 20
CACHE_WORDS = 400_000
#: Log odds of every document if nothing is labelled.
NO_LABELS = -4.0
_TOKEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
SCHEMA = "doc_id long, score double, sum_marginal double, max_marginal double, n_tokens long, spans array<struct<start:int,end:int>>"


def features(word: bytes) -> list[bytes]:
    """The word and its first three, four and five letters."""
    text = word.decode("utf-8", "replace")
    return [b"w:" + word] + [b"p:" + text[:n].encode() for n in (3, 4, 5) if len(text) > n]


class Unaries(dict):
    """Unary score of a word for the toxic state, from feature weights."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: bytes) -> float:
        get = self.weights.get
        u = self.bias + sum(get(f, 0.0) for f in features(word))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = u
        return u


@dataclass
class Chain:
    """Weights of the two-state chain: feature weights and bias of the toxic state, log potentials of start and steps."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -4.0
    start: float = 0.0
    steps: tuple[float, float, float] = (-1.0, -1.0, 0.5)  # clean to toxic, toxic to clean, toxic to toxic; clean to clean: 0


class Lanes:
    """Texts whose tokens are joined, cut into lanes of at most LANE tokens; the longest lanes come first."""

    def __init__(self, sizes: np.ndarray):
        counts = -(-sizes // LANE)
        self.text = np.repeat(np.arange(len(sizes)), counts)
        k = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(np.cumsum(sizes) - sizes, counts) + k * LANE
        length = np.minimum(LANE, np.repeat(sizes, counts) - k * LANE)
        order = np.argsort(-length, kind="stable")
        self.start, self.length, self.first = start[order], length[order], (k == 0)[order]
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        #: Places of the lanes of each text of several lanes, in its order.
        self.long = [at[e - c : e] for e, c in zip(np.cumsum(counts).tolist(), counts.tolist()) if c > 1]
        self.text = self.text[order]

    def blocks(self, cells: int) -> Iterator[slice]:
        """Lanes of like lengths, of bounded padded size together."""
        lo = 0
        while lo < len(self.length):
            hi = min(len(self.length), lo + max(1, cells // int(self.length[lo])))
            yield slice(lo, hi)
            lo = hi


def _padded(chain: Chain, unary: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-major factors exp(unary) of lanes, longest first, and how many lanes are as long as each time."""
    t_max = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, t_max + 1), side="right")
    at = np.minimum(starts[None, :] + np.arange(t_max)[:, None], max(0, len(unary) - 1))
    return np.exp(np.clip(unary, -30, 30))[at] if t_max else np.zeros((0, 0)), active


def borders(chain: Chain, unary: np.ndarray, lanes: Lanes, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """For every lane the forward ratio before its first token and the backward ratio at its last one.

    A lane's tokens multiply to one 2 x 2 matrix, found for all lanes of long texts in lock-step; along a text the
    matrices carry both messages over the borders, so cutting changes nothing but the order of multiplications."""
    before, after = np.zeros(len(lanes.length)), np.ones(len(lanes.length))
    if not lanes.long:
        return before, after
    e01, e10, e11 = np.exp(chain.steps)
    which = np.sort(np.concatenate(lanes.long))  # in order of lengths still
    m = np.zeros((len(which), 2, 2))
    for lo in range(0, len(which), max(1, cells // LANE)):
        part = which[lo : lo + max(1, cells // LANE)]
        u, active = _padded(chain, unary, lanes.start[part], lanes.length[part])
        first = lanes.first[part]
        x = np.broadcast_to(np.eye(2), (len(part), 2, 2)).copy()
        for t in range(len(u)):
            n = active[t]
            a, b = x[:n, :, 0], x[:n, :, 1]
            new = np.stack([a + b * e10, (a * e01 + b * e11) * u[t, :n, None]], axis=2)
            if t == 0:
                new[first[:n]] = np.eye(2)  # a text's first token has no step before it
            x[:n] = new / new.sum((1, 2), keepdims=True)
        m[lo : lo + len(part)] = x
    matrix = dict(zip(which.tolist(), m))
    for of in lanes.long:
        head = of[0]
        state = np.array([1.0, math.exp(min(30.0, max(-30.0, unary[lanes.start[head]])) + chain.start)])
        for here, following in zip(of[:-1].tolist(), of[1:].tolist()):
            state = state @ matrix[here]
            state /= state.sum()
            before[following] = state[1] / state[0]
        state = np.ones(2)
        for here, following in zip(of[-2::-1].tolist(), of[:0:-1].tolist()):
            state = matrix[following] @ state
            state /= state.sum()
            after[here] = state[1] / state[0]
    return before, after


def forward_backward(chain: Chain, unary: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Messages of lanes, longest first, in lock-step, as ratios toxic to clean: time-major factors exp(unary), forward
    and backward ratios. `before` and `after` are the ratios at the lanes' borders, `first` marks beginnings of texts."""
    u, active = _padded(chain, unary, starts, sizes)
    e01, e10, e11 = np.exp(chain.steps)
    f, b = np.zeros_like(u), np.ones_like(u)
    for t in range(len(u)):
        n = active[t]
        last = before if t == 0 else f[t - 1, :n]
        step = (e01 + e11 * last) / (1 + e10 * last)
        f[t, :n] = u[t, :n] * (np.where(first, math.exp(chain.start), step) if t == 0 else step)
    if len(u):
        b[sizes - 1, np.arange(len(sizes))] = after
    for t in range(len(u) - 2, -1, -1):
        n = active[t + 1]
        nxt = u[t + 1, :n] * b[t + 1, :n]
        b[t, :n] = (e10 + e11 * nxt) / (1 + e01 * nxt)
    return u, f, b


def marginals(chain: Chain, unary: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Probability that each token is toxic; texts' tokens are joined, `sizes` are their numbers."""
    out = np.zeros(len(unary))
    lanes = Lanes(sizes)
    before, after = borders(chain, unary, lanes, CELLS)
    for k in lanes.blocks(CELLS):
        _, f, b = forward_backward(chain, unary, lanes.start[k], lanes.length[k], lanes.first[k], before[k], after[k])
        p = f * b
        p /= 1 + p
        time = np.arange(len(p))[:, None]
        mask = time < lanes.length[None, k]
        out[(lanes.start[None, k] + time)[mask]] = p[mask]
    return out


def expectations(chain: Chain, unary: np.ndarray, lanes: Lanes, n_texts: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all tokens; expected numbers of the three steps in each lane; log partition function of each text."""
    flat, steps = np.zeros(len(unary)), np.zeros((len(lanes.length), 3))
    log_z = np.zeros(n_texts)
    before, after = borders(chain, unary, lanes, cells)
    last = np.ones(len(lanes.length), bool)
    for of in lanes.long:
        last[of[:-1]] = False
    e01, e10, e11 = np.exp(chain.steps)
    for k in lanes.blocks(cells):
        n, first = lanes.length[k], lanes.first[k]
        u, f, b = forward_backward(chain, unary, lanes.start[k], n, first, before[k], after[k])
        p = f * b
        p /= 1 + p
        time = np.arange(len(p))[:, None]
        mask = time < n[None, :]
        flat[(lanes.start[None, k] + time)[mask]] = p[mask]
        prev = np.concatenate([before[k][None, :], f[:-1]])
        inside = mask & ~(first[None, :] & (time == 0))  # steps into tokens that have one before them
        w01, w10, w11 = e01 * u * b, e10 * prev, e11 * prev * u * b
        z = 1 + w01 + w10 + w11
        steps[k] = np.stack([np.where(inside, w / z, 0).sum(0) for w in (w01, w10, w11)], axis=1)
        grown = np.where(inside, np.log1p(w10), 0).sum(0) + np.where(last[k], np.log1p(f[n - 1, np.arange(len(n))]), 0)
        log_z += np.bincount(lanes.text[k], weights=grown, minlength=n_texts)
    return flat, steps, log_z


def train_chain(docs: list[tuple[int, int, list[int], list[list[int]]]], names: list[bytes], rounds: int = SEED_ROUNDS, em_rounds: int = EM_ROUNDS) -> Chain:
    """Fit the chain by Adam steps on the log-likelihood of the tags: first those of the features, then expected ones.
    A document: toxic or not, tokens, places of tokens that have features, and these features' numbers."""
    chain = Chain()
    docs = [d for d in docs if d[1]]
    if not docs or not names:
        return chain
    sizes = np.array([d[1] for d in docs], np.int64)
    toxic = np.array([d[0] > 0 for d in docs])
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    gold = np.zeros(total)
    token, feat = [], []
    for s, (bad, _, places, found) in zip(starts.tolist(), docs):
        for at, fs in zip(places, found):
            gold[s + at] = bad
            token += [s + at] * len(fs)
            feat += fs
    token, feat = np.array(token, np.int64), np.array(feat, np.int64)
    first = np.zeros(total, bool)
    first[starts] = True
    prev = np.concatenate([[0.0], gold[:-1]])
    seen = np.array([((1 - prev) * gold)[~first].sum(), (prev * (1 - gold))[~first].sum(), (prev * gold)[~first].sum()])
    lanes = Lanes(sizes)
    of = np.repeat(np.arange(len(docs)), sizes)
    x = np.concatenate([np.zeros(len(names)), [chain.bias, chain.start], chain.steps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    n_f = len(names)
    for step in range(1, rounds + em_rounds + 1):
        chain = Chain({}, x[n_f], x[n_f + 1], tuple(x[n_f + 2 :]))
        unary = np.full(total, chain.bias) + np.bincount(token, weights=x[feat], minlength=total)
        flat, steps, log_z = expectations(chain, unary, lanes, len(docs), CHAIN_CELLS)
        if step > rounds:  # given at least one toxic token, or none, expectations grow by 1 / P(any), or vanish
            scale = np.where(toxic, 1 / np.maximum(-np.expm1(-log_z), 1e-12), 0.0)
            gold, seen = np.minimum(1.0, flat * scale[of]), (steps * scale[lanes.text][:, None]).sum(0)
        miss = gold - flat
        grad = np.concatenate([np.bincount(feat, weights=miss[token], minlength=n_f), [miss.sum(), miss[first].sum()], seen - steps.sum(0)])
        grad = grad - 0.1 * x
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        x = x + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
    return Chain({n: float(w) for n, w in zip(names, x[:n_f]) if abs(w) > 1e-3}, float(x[n_f]), float(x[n_f + 1]), tuple(map(float, x[n_f + 2 :])))


@dataclass
class ToxicityModel:
    chain: Chain
    judge: Logistic

    def scores(self, s: np.ndarray, top: np.ndarray, n: np.ndarray) -> np.ndarray:
        return sigmoid(self.judge.logit(evidence(s, top, n)))


def evidence(s: np.ndarray, top: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the document score is made of: sum, maximum and density of marginals."""
    return np.column_stack([np.log1p(10 * s), top, np.log1p(1000 * s / np.maximum(n, 1))])


def _tokens(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray]:
    split = [words_of(t) for t in texts]
    return split, np.array([len(w) for w in split], np.int64)


def _marginals_of(chain: Chain, cache: Unaries, split: list[list[bytes]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all tokens; their sum and maximum for each text."""
    get = cache.__getitem__
    unary = np.fromiter((u for w in split for u in map(get, w)), np.float64, int(sizes.sum()))
    p = marginals(chain, unary, sizes)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.diff(np.concatenate([[0.0], np.cumsum(p)])[edges])
    tops = np.zeros(len(sizes))
    full = np.flatnonzero(sizes)
    if len(full):
        tops[full] = np.maximum.reduceat(p, edges[:-1][full])
    return p, np.maximum(sums, tops), tops


def train_fold(labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """doc_id and toxic (0 or 1) of at most `limit` labelled documents outside the held-out fold. Rows with a null in
    either are left out; if labels of one document differ, it is toxic."""
    one = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as bigint) as string)) % 5 <> 0")
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> ToxicityModel:
    """Fit the chain and the document judge to labelled documents of the training folds.

    Without any toxic, or any other, labelled document the model scores texts by the rate seen; without any labelled
    document at all none is toxic.
    """
    bound_arrow_batches(docs.sparkSession)
    chosen = F.broadcast(train_fold(labels, limit))  # at most `limit` pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    sample = materialize(texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean_docs, toxic_docs, n = Counter(), Counter(), [0, 0]

        def flush() -> pa.RecordBatch:
            names = list(toxic_docs.keys() | clean_docs.keys())
            columns = [[b"", *names], [n[1], *map(toxic_docs.__getitem__, names)], [n[0], *map(clean_docs.__getitem__, names)]]
            toxic_docs.clear()
            clean_docs.clear()
            n[:] = [0, 0]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()))], names=["feature", "toxic", "clean"])

        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[toxic > 0] += 1
                (toxic_docs if toxic > 0 else clean_docs).update({f for w in set(words_of(text)) for f in features(w)})
            if len(toxic_docs) + len(clean_docs) > CACHE_WORDS:
                yield flush()
        yield flush()

    counted = sample.select("toxic", "text").mapInArrow(tally, "feature binary, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.where(f"toxic >= {MIN_DOCS} or feature = X''")
    counted = materialize(counted, "toxicity-features")
    total = counted.agg(F.sum(F.expr("case when feature = X'' then toxic end")).alias("t"), F.sum(F.expr("case when feature = X'' then clean end")).alias("c"))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("t") + 1)) - F.log((F.col("clean") + 0.5) / (F.col("c") + 1))
    scored = counted.crossJoin(F.broadcast(total)).withColumn("odds", odds)  # one row beside each
    best = scored.where(f"feature <> X'' and odds >= {MIN_LOG_ODDS}").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "feature")
    names = [bytes(r[0]) for r in best.select("feature").collect()]
    number = docs.sparkSession.sparkContext.broadcast({n: k for k, n in enumerate(names)})

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.value.get
        for b in batches:
            sizes, places, found = [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                at = [(k, fs) for k, w in enumerate(words) if (fs := [i for f in features(w) if (i := get(f)) is not None])]
                sizes.append(len(words))
                places.append([k for k, _ in at])
                found.append([fs for _, fs in at])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["toxic", "n", "places", "found"])

    halves = [sample.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CHAIN_DOCS // 2) for c in ("toxic > 0", "toxic <= 0")]
    rows = []
    for half in halves:
        spotted = materialize(half.select("toxic", "text").mapInArrow(spots, "toxic int, n long, places array<int>, found array<array<int>>").withColumn("at", F.monotonically_increasing_id()), "toxicity-spots")
        room, chosen = CHAIN_WORDS // 2, []
        for at, n in spotted.select("at", "n").orderBy("at").collect():  # CHAIN_DOCS / 2 rows at most
            if n <= room:
                chosen.append(at)
                room -= n
        rows += spotted.where(F.col("at").isin(chosen)).orderBy("at").drop("at").collect()
    chain = train_chain([(int(r[0] > 0), r[1], r[2], r[3]) for r in rows], names)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Unaries(shared.value.weights, shared.value.bias)
        for b in batches:
            split, sizes = _tokens(b.column(1).to_pylist())
            _, sums, tops = _marginals_of(shared.value, cache, split, sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums), pa.array(tops), pa.array(sizes)], names=["toxic", "s", "top", "n"])

    found = np.array([tuple(r) for r in sample.select("toxic", "text").mapInArrow(measure, "toxic int, s double, top double, n long").collect()], float).reshape(-1, 4)
    judge = Logistic(evidence(found[:, 1], found[:, 2], found[:, 3]), (found[:, 0] > 0).astype(float))
    if not len(found):
        judge.weights[0] = NO_LABELS
    return ToxicityModel(chain, judge)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The model's score of each whole text, sum and maximum of its tokens' marginals, and offending spans in characters.

    One row per input row. Null and empty texts have no tokens and get the score of no evidence; repeated rows and null
    ids are kept; columns other than doc_id and text are ignored.
    """
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = Unaries(m.chain.weights, m.chain.bias)
        for b in batches:
            texts = b.column(1).to_pylist()
            split, sizes = _tokens(texts)
            p, sums, tops = _marginals_of(m.chain, cache, split, sizes)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            spans = [spans_of(t, p[lo:hi]) if top >= 0.5 else [] for t, lo, hi, top in zip(texts, edges[:-1], edges[1:], tops)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(sums, tops, sizes)), pa.array(sums), pa.array(tops), pa.array(sizes), pa.array(spans, kind)], names=["doc_id", "score", "sum_marginal", "max_marginal", "n_tokens", "spans"])

    return source.mapInArrow(run, SCHEMA)


def keep_below(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose score is under `limit`; as score() otherwise."""
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = Unaries(m.chain.weights, m.chain.bias)
        for b in batches:
            split, sizes = _tokens(bytes_of(b.column(0), "text"))
            _, sums, tops = _marginals_of(m.chain, cache, split, sizes)
            yield b.filter(pa.array(m.scores(sums, tops, sizes) < limit))

    return source.mapInArrow(run, source.schema).select("row.*")


def spans_of(text: bytes, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of tokens with a marginal of at least `least`, as character offsets."""
    out: list[dict] = []
    last = -2
    for k, found in enumerate(_TOKEN.finditer(text.decode("utf-8", "replace"))):
        if p[k] >= least:
            if last == k - 1:
                out[-1]["end"] = found.end()
            else:
                out.append({"start": found.start(), "end": found.end()})
            last = k
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() of all documents with held_out and predicted, by a model of the labels outside the held-out fold."""
    scored = score(docs, fit(docs, labels))
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "max_marginal", "sum_marginal", "spans")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't call toxic."""
    return keep_below(docs, fit(docs, labels))
