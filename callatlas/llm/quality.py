"""Quality classification with hierarchical empirical Bayes over sites.

A logistic model of a document's own text gives evidence, as a log likelihood ratio. Labelled documents of a host, and
of a path on it, give rates of good documents; each path's rate is shrunk towards its host's and each host's towards
the global rate, with strengths estimated from the spread of the rates between sites (method of moments), so sparse
sites follow their parents. Posterior log odds of a document = evidence + log odds of its path's posterior rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callatlas.llm.common import bound_arrow_batches, bytes_of, materialize, salted_left_join
from callatlas.llm.linear import Logistic

#: Labelled documents that the text model is fitted to at most: the first by a hash of their ids.
TRAIN_DOCS = 16_000
#: Sites whose posteriors are broadcast at most; more are joined by shuffling, with salts.
BROADCAST_SITES = 50_000
#: Bounds on the prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
_LETTERS = bytes(c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SPACES = bytes([9, 10, 11, 12, 13, 32])
_ENDS = b".,;:?'\""
_OTHER = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in _ENDS))
_LOWER_TO_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or 48 <= c <= 57 else 32 for c in range(256))
N_FEATURES = 12


def text_features(text: bytes | None) -> list[float]:
    """Shares of letters, capitals, digits, sentence marks, other marks; lengths of words, lines; repetition."""
    if not text:
        return [0.0] * N_FEATURES
    n = len(text)
    count = lambda which: n - len(text.translate(None, which))
    words = text.translate(_LOWER_TO_WORD).split()
    tokens = len(text.split())
    letters = count(_LETTERS)
    lines = text.split(b"\n")
    return [
        1.0,
        letters / n,
        count(_UPPER) / max(1, letters),
        count(_DIGITS) / n,
        count(_ENDS) / n,
        count(_OTHER) / n,
        min(2.0, text.count(b"|") / max(1, tokens)),
        min(4.0, count(b"!") / max(1, tokens)),
        sum(map(len, words)) / max(1, len(words)),
        len(set(words)) / max(1, len(words)) ** 0.75,
        len(set(lines)) / len(lines),
        min(1.0, sum(map(len, (w for w in words if len(w) < 4))) / n * 4),
    ]


def _site(docs: DataFrame) -> list:
    """Host and path of a document: its source and, on it, its language; nulls count as a site of their own."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return [named("source").alias("host"), named("lang").alias("path")]


def labelled(labels: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id and good (0 or 1) of labelled documents outside the held-out fold, or with `whole` of all; if labels of
    one document differ: 0."""
    one = labels.where("doc_id is not null and quality is not null")
    if not whole:
        one = one.where("crc32(cast(cast(doc_id as bigint) as string)) % 5 <> 0")
    return one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("good"))


def fit_text_model(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Logistic:
    bound_arrow_batches(docs.sparkSession)
    chosen = F.broadcast(labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))  # at most `limit` pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "good", "x"])

    rows = texts.join(chosen, "doc_id").select("doc_id", "good", "text").mapInArrow(measure, "doc_id long, good int, x array<double>").groupBy("doc_id", "good").agg(F.min("x").alias("x")).collect()
    return Logistic(np.array([r[2] for r in rows], float).reshape(-1, N_FEATURES), np.array([r[1] > 0 for r in rows], float))


def strength(groups: DataFrame, rate: str) -> float:
    """Prior documents per site: within-site over between-site variance of the rates around their parents' `rate`."""
    p = F.col(rate)
    r = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2)), F.sum(p * (1 - p)), F.sum("n"), F.sum(F.pow(F.col("n").cast("double"), 2)), F.count("*"), F.sum(F.col("n") * p * (1 - p))
    ).first()
    if not r[4] or not r[2]:
        return MOST_STRENGTH
    within = r[5] / r[2]
    between = (r[0] - r[1]) / r[2]  # a rate of no spread but chance has E[n (rate - p)^2] = p (1 - p)
    return float(np.clip(within / between, LEAST_STRENGTH, MOST_STRENGTH)) if between > 1e-12 else MOST_STRENGTH


def site_posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """host, path, n, global_rate, host_rate, path_rate of every site in docs, shrunk along the hierarchy."""
    sites = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_site(docs))
    paths = materialize(sites.join(labelled(labels, whole=True), "doc_id", "left").groupBy("host", "path").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")), "paths")
    n, good = paths.agg(F.sum("n"), F.sum("good")).first()
    overall = (float(good or 0) + 1) / (float(n or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("global_rate", F.lit(overall))
    k_host = strength(hosts, "global_rate")
    hosts = hosts.select("host", "global_rate", ((F.col("good") + k_host * F.col("global_rate")) / (F.col("n") + k_host)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k_path = strength(paths, "host_rate")
    return paths.select("host", "path", "n", "global_rate", "host_rate", ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"))


def _judged(docs: DataFrame, labels: DataFrame, source: DataFrame, texts) -> DataFrame:
    """`source` (first column: texts or rows; then host and path) with evidence, host_rate, path_rate and posterior."""
    bound_arrow_batches(docs.sparkSession)
    model = fit_text_model(docs, labels)
    sites = materialize(site_posteriors(docs, labels), "sites")
    first = sites.select("global_rate").first()
    prior = first[0] if first else 0.5
    shared = docs.sparkSession.sparkContext.broadcast((model, float(np.log(prior / (1 - prior)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at = shared.value
        for b in batches:
            x = np.array([text_features(t) for t in texts(b.column(0))], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.logit(x) - at)], names=b.schema.names)

    scored = source.withColumn("evidence", F.lit(0.0))
    scored = scored.mapInArrow(run, scored.schema)
    rates = sites.select("host", "path", "host_rate", "path_rate")
    joined = scored.join(F.broadcast(rates), ["host", "path"], "left") if sites.count() <= BROADCAST_SITES else salted_left_join(scored, rates, ["host", "path"])
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    return joined.withColumn("posterior", F.expr("1.0") / (1 + F.exp(-odds)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, posterior and the decision, keep (posterior at least 0.5).

    One row per input row; null and empty texts have no features; null hosts and paths are sites of their own; repeated
    rows and null ids are kept; other columns are ignored. Without labels every site has the rate 1/2 and the text model
    gives no evidence.
    """
    source = docs.select(F.col("text").cast("string").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *_site(docs))
    out = _judged(docs, labels, source, lambda column: column.to_pylist())
    return out.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") >= 0.5).alias("keep"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, that are judged good; as quality() otherwise."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_site(docs))
    return _judged(docs, labels, source, lambda column: bytes_of(column, "text")).where("posterior >= 0.5").select("row.*")
