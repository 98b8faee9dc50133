"""Embeddings, nearest neighbours, clones, hashing buckets, density clusters and their labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callatlas.functions.text import container_name, pascal_split, short_name, signature_tokens
from callatlas.operators.graph import components
from callatlas.operators.shards import Rows, against_shards, by_length
from callatlas.sources.scratch import materialize

DIMS = 384
#: Prefixes of a token, and vectors of a bucket, that are joined with each other as one; more are cut into cells.
CELL_ROWS, BUCKET_ROWS = 2000, 256
#: Scores of queries against a shard that are held at a time: 32 MB of doubles.
TILE = 4 << 20
#: Verbs and nouns that labels pass over, lower-cased.
STOPWORDS = ("get", "set", "the", "and", "for", "with", "from", "this", "that", "async", "to", "of", "is", "has", "on", "in", "by")
#: Words of test names.
TEST_WORDS = ("test", "tests", "should", "verify", "assert", "fact", "theory")


def hash_embedding(texts: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """Sparse signed feature hashing of words (weight 1) and word pairs (0.5), of unit length: id, idx, val. Words stand
    between single spaces; index and sign come from SHA-256."""
    w = F.filter(F.split(F.col(text_col), " "), lambda s: s != "")
    row = texts.select(F.col(id_col).alias("id"), w.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws("_", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    both = row.select("id", F.explode(F.concat(F.transform("w", lambda s: F.struct(s.alias("t"), F.lit(1.0).alias("x"))), F.transform(pairs, lambda s: F.struct(s.alias("t"), F.lit(0.5).alias("x"))))).alias("p"))
    weighed = both.groupBy("id", F.col("p.t").alias("t")).agg(F.sum("p.x").alias("x"))  # each word is hashed once per text
    h, g = F.sha2(F.concat(F.lit("0:"), "t"), 256), F.sha2(F.concat(F.lit("1:"), "t"), 256)
    little = F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(g, 2, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    cells = weighed.select("id", (little % dims).cast("int").alias("idx"), (sign * F.col("x")).alias("x")).groupBy("id", "idx").agg(F.sum("x").alias("x"))
    norm = cells.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return cells.join(norm, "id").where("x <> 0").select("id", "idx", (F.col("x") / F.col("norm")).alias("val"))


def dense(cells: DataFrame, dims: int = DIMS) -> DataFrame:
    """method_id and vector of hash_embedding() rows."""
    m = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("m"))  # at most `dims` entries
    return m.select(F.col("id").alias("method_id"), F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("vector"))


def check_vectors(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """The rows, or an error on null, NaN or infinite components or another dimension."""
    v = F.col("vector")
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dims is not None:
        bad = bad | (F.size(v) != dims)
    return vectors.where(F.when(bad, F.raise_error(F.lit("invalid vector")).cast("boolean")).otherwise(F.lit(True)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k rows nearest a query vector by cosine; ties: smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("method_id", cosine(F.col("vector").cast("array<double>"), q).alias("score")).orderBy(F.desc("score"), "method_id").limit(k)


def similar(vectors: DataFrame, method_id: str, k: int = 10) -> DataFrame:
    """The k methods most similar to one: the k + 1 nearest without itself."""
    row = vectors.where(F.col("method_id") == method_id).select("vector").first()
    if row is None:
        return vectors.select("method_id", F.lit(0.0).alias("score")).limit(0)
    return top_k(vectors, row[0], k + 1).where(F.col("method_id") != method_id).limit(k)


def _keyed(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("method_id").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("id is not null and v is not null")


def _by_id(rows: Rows) -> Rows:
    return {n: (ids[order], m[order]) for n, (ids, m) in rows.items() for order in [np.argsort(ids, kind="stable")]}


def _units(rows: Rows) -> Rows:
    out = {}
    for n, (ids, m) in rows.items():
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        out[n] = (ids, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))
    return out


def _tiles(queries: int, candidates: int) -> Iterator[slice]:
    """Queries in runs whose scores against all candidates make a tile."""
    step = max(1, TILE // max(1, candidates))
    return (slice(k, k + step) for k in range(0, queries, step))


def knn(vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, method_id, score and rank of each vector's k + 1 nearest by cosine, itself included.

    Vectors are hashed to shards of bounded size; as queries they stream past every shard in blocks. A shard keeps its
    own best before anything is shuffled. Vectors without id or value take no part, others meet those of their length."""

    def ask(shard: Rows, asked: Rows, _: list) -> Iterator[pa.RecordBatch]:
        for n, (names, q) in _units(asked).items():
            if n not in shard:
                continue
            ids, m = shard[n]
            keep = min(k + 1, m.shape[0])
            for rows in _tiles(len(q), len(m)):
                scores = q[rows] @ m.T
                least = np.partition(scores, len(m) - keep, axis=1)[:, len(m) - keep]
                r, c = np.nonzero(scores >= least[:, None] - 1e-6)
                best = scores[r, c]
                order = np.lexsort((c, -best, r))  # of equal scores only the smallest ids can be among the best
                r, c, best = r[order], c[order], best[order]
                head = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (best[1:] != best[:-1])]))
                few = np.arange(len(r)) - np.repeat(head, np.diff(np.append(head, len(r)))) < keep
                yield pa.RecordBatch.from_arrays([pa.array(names[rows][r[few]], pa.string()), pa.array(ids[c[few]], pa.string()), pa.array(best[few])], names=["query_id", "method_id", "score"])

    rows = _keyed(vectors)
    near = against_shards(rows, rows, lambda found: _units(_by_id(found)), ask, "query_id string, method_id string, score double")
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "method_id")  # sums in another order differ in the last bits
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)


def semantic_clones(vectors: DataFrame, threshold: float = 0.85, k: int = 10) -> DataFrame:
    """Unordered pairs of which either lists the other among its k + 1 nearest, with cosine at least `threshold`."""
    near = knn(vectors, k).where((F.col("query_id") != F.col("method_id")) & (F.col("score") >= threshold))
    return near.groupBy(F.least("query_id", "method_id").alias("method_id_a"), F.greatest("query_id", "method_id").alias("method_id_b")).agg(F.max("score").alias("semantic_similarity"))


def structural_classes(signatures: DataFrame, id_col: str = "method_id", text_col: str = "structural_signature") -> DataFrame:
    """Class of equal token sets and bag sizes: rep (smallest id), n_members, tokens (sorted set), n_bag. Signatures
    without tokens are left out. Members are counted, never gathered."""
    t = _keyed_sets(signatures, id_col, text_col).groupBy("same", "n_bag").agg(F.first("tokens").alias("tokens"), F.min("id").alias("rep"), F.count("*").alias("n_members"))
    return t.select("tokens", "n_bag", "rep", "n_members")


def structural_members(signatures: DataFrame, id_col: str = "method_id", text_col: str = "structural_signature") -> DataFrame:
    """id and rep (smallest id) of its class of equal token sets and bag sizes, a row for each signature with tokens."""
    t = materialize(_keyed_sets(signatures, id_col, text_col).select("id", "same", "n_bag"), "sets")
    return t.join(t.groupBy("same", "n_bag").agg(F.min("id").alias("rep")), ["same", "n_bag"]).select("id", "rep")


def _keyed_sets(signatures: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tokens (sorted set), n_bag and `same`, the SHA-256 of the tokens, which stands for them in shuffles. Tokens
    hold no line ends, so that the text of a set is its own alone."""
    t = signatures.select(F.col(id_col).alias("id"), signature_tokens(F.col(text_col)).alias("bag")).where("size(bag) > 0")
    t = t.select("id", F.array_sort(F.array_distinct("bag")).alias("tokens"), F.size("bag").alias("n_bag"))
    return t.withColumn("same", F.unhex(F.sha2(F.array_join("tokens", "\n"), 256)))


def member_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of class representatives (a, b, similarity) as pairs of all their members, with those inside a class at
    similarity 1. The output is as long as the classes' sizes multiplied."""
    m = materialize(members, "members")
    x, y = m.select(F.col("rep").alias("ra"), F.col("id").alias("a")), m.select(F.col("rep").alias("rb"), F.col("id").alias("b"))
    inside = x.join(y, F.expr("ra = rb and a < b")).select("a", "b", F.lit(1.0).alias("similarity"))
    between = pairs.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "similarity").join(x, "ra").join(y, "rb")
    return inside.union(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"))


def pairs_among(asked: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of the pairs (a, b) asked for, those that are structurally alike, with their similarity: 1 inside a class, that of
    the representatives between classes. As long as `asked` at most, however large the classes are."""
    x, y = members.select(F.col("id").alias("a"), F.col("rep").alias("ra")), members.select(F.col("id").alias("b"), F.col("rep").alias("rb"))
    placed = asked.select("a", "b").join(x, "a").join(y, "b")
    both = pairs.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "similarity")
    both = both.union(both.select("rb", "ra", "similarity"))
    found = placed.join(both, ["ra", "rb"], "left").withColumn("similarity", F.when(F.col("ra") == F.col("rb"), 1.0).otherwise(F.col("similarity")))
    return found.where("similarity is not null").select("a", "b", "similarity")


def structural_clones(signatures: DataFrame, threshold: float = 0.8, id_col: str = "method_id", text_col: str = "structural_signature") -> DataFrame:
    """Pairs of class representatives with Jaccard similarity of token sets, and ratio of bag sizes, of at least
    `threshold`: a, b, similarity, clone_type. structural_members() gives the other members. Exact, by prefix filtering:
    sets that similar share one of their n - ceil(t n) + 1 rarest tokens, so only those are joined on; sizes, the places
    of the shared token and sketches prune inside the join, so that few pairs carry their tokens to be compared. A sketch
    has a bit for each of 256 hashes, set if an odd number of tokens has it: two differ in no more bits than the sets in
    tokens."""
    classes = materialize(structural_classes(signatures, id_col, text_col), "classes")
    df = classes.select(F.explode("tokens").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    ranked = classes.select("rep", "n_bag", F.size("tokens").alias("n"), F.explode("tokens").alias("tok")).join(df, "tok")
    place = W.partitionBy("rep", "n_bag", "n").orderBy("df", "tok")
    prefix = ranked.withColumn("p", F.row_number().over(place)).where(F.expr(f"p <= n - ceil({threshold} * n - 1e-9) + 1"))
    odd = "aggregate(transform(tokens, t -> xxhash64(t)), 0L, (s, h) -> s ^ if(pmod(h, 4) = {}, shiftleft(1L, cast(pmod(shiftright(h, 2), 64) as int)), 0L))"
    sketch = classes.select("rep", "n_bag", *[F.expr(odd.format(k)).alias(f"s{k}") for k in range(4)])
    prefix = materialize(prefix.select("tok", "rep", "n", "n_bag", "p").join(sketch, ["rep", "n_bag"]), "prefix")
    # a token of many prefixes is cut into cells by a hash of rep, and each pair of its cells is joined by itself
    cells = prefix.groupBy("tok").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cells"))
    cut = prefix.join(cells, "tok").withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cut = cut.select("tok", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "rep", "n", "n_bag", "p", "s0", "s1", "s2", "s3")
    x, y = cut, cut.select(*[F.col(c).alias(f"{c}_y") for c in cut.columns])
    meet = "tok = tok_y and i = i_y and j = j_y and rep < rep_y and (cell <> cell_y) = (i <> j)"
    alike = f"least(n, n_y) >= {threshold} * greatest(n, n_y) - 1e-9 and least(n_bag, n_bag_y) >= {threshold} * greatest(n_bag, n_bag_y) - 1e-9"
    # at the first token that two sets share, what follows in both must make up the overlap that is needed
    enough = f"1 + least(n - p, n_y - p_y) >= {threshold} / (1 + {threshold}) * (n + n_y) - 1e-9"
    apart = " + ".join(f"bit_count(s{k} ^ s{k}_y)" for k in range(4)) + f" <= {(1 - threshold) / (1 + threshold)!r}D * (n + n_y) + 1e-6"  # a double: decimals would be cut
    near = x.join(y, F.expr(f"{meet} and {alike} and {enough} and {apart}")).select(F.col("rep").alias("a"), F.col("rep_y").alias("b")).distinct()
    sets = classes.select("rep", "tokens")
    both = near.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    jac = common / (F.size("ta") + F.size("tb") - common)
    out = both.select("a", "b", jac.alias("similarity")).where(F.col("similarity") >= threshold)
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"), F.when(F.col("similarity") > 0.95, "Type1").otherwise("Type2").alias("clone_type"))


def hybrid(structural: DataFrame, semantic: DataFrame, alpha: float = 0.4, least: float = 0.5) -> DataFrame:
    """Pairs of either kind on normalized keys with h = alpha s + (1 - alpha) m >= least. Inputs: a, b, similarity."""
    norm = lambda d, c: d.groupBy(F.least("a", "b").alias("method_id_a"), F.greatest("a", "b").alias("method_id_b")).agg(F.max("similarity").alias(c))
    both = norm(structural, "s").join(norm(semantic, "m"), ["method_id_a", "method_id_b"], "full_outer")
    s, m = F.coalesce("s", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    both = both.select("method_id_a", "method_id_b", s.alias("structural_similarity"), m.alias("semantic_similarity"), F.round(alpha * s + (1 - alpha) * m, 6).alias("hybrid_score"))
    kind = F.when(F.col("structural_similarity") > 0.95, "Type1").when(F.col("structural_similarity") > 0.8, "Type2").otherwise("Semantic")
    return both.where(F.col("hybrid_score") >= least).withColumn("clone_type", kind)


def _lsh_keys(vectors: DataFrame, planes: int, bands: int, seed: int) -> DataFrame:
    """id and v, the buckets of its bands in their order, as doubles."""
    rows = planes // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for b in batches:
            for n, (ids, m) in by_length(np.array(b.column(0).to_pylist(), object), b.column(1)).items():
                if n not in drawn:
                    drawn[n] = np.random.default_rng(seed).standard_normal((planes, n))
                bits = (m @ drawn[n].T >= 0).reshape(len(m), bands, rows)
                key = (bits * (1 << np.arange(rows))).sum(2) + (np.arange(bands) << rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(m) + 1, bands, dtype=np.int32)), pa.array(key.ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), lists], names=["id", "v"])

    return _keyed(vectors).mapInArrow(run, "id string, v array<double>")


def lsh_buckets(vectors: DataFrame, planes: int = 32, bands: int = 8, seed: int = 42) -> DataFrame:
    """id and bucket, one for each band: the band and the sign pattern of its random hyperplanes. The planes are normal
    deviates of the seed, drawn for the vectors' length."""
    return _lsh_keys(vectors, planes, bands, seed).select("id", F.explode(F.col("v").cast("array<long>")).alias("bucket"))


def lsh_candidates(vectors: DataFrame, planes: int = 32, bands: int = 8, seed: int = 42) -> DataFrame:
    """Pairs a < b that share a bucket in one band at least, each once. Buckets are few, so pairs are many; use
    lsh_pairs() for those within a distance. Vectors meet by all their buckets at once, each with those of greater ids,
    so pairs need not be made distinct, unless ids come more than once."""
    rows = materialize(_lsh_keys(vectors, planes, bands, seed), "buckets")

    def ask(shard: Rows, asked: Rows, _: list) -> Iterator[pa.RecordBatch]:
        for n, (names, q) in asked.items():
            if n not in shard:
                continue
            ids, m = shard[n]
            after = np.searchsorted(ids, names, side="right")
            order = np.argsort(after, kind="stable")
            left, right, q, after = pa.array(names[order], pa.string()), pa.array(ids, pa.string()), q[order].astype(np.int32), after[order]
            columns = np.ascontiguousarray(m.T.astype(np.int32))
            for rows in _tiles(len(q), len(m)):
                low = int(after[rows.start])
                shared = np.zeros((len(q[rows]), len(m) - low), bool)
                for b in range(n):
                    shared |= q[rows, b, None] == columns[b, low:]
                shared &= np.arange(low, len(m)) >= after[rows, None]
                r, c = np.nonzero(shared)
                yield pa.RecordBatch.from_arrays([left.take(pa.array(r + rows.start)), right.take(pa.array(c + low))], names=["a", "b"])

    pairs = against_shards(rows, rows, _by_id, ask, "a string, b string")
    return pairs if rows.groupBy("id").count().where("count > 1").isEmpty() else pairs.distinct()


def lsh_pairs(vectors: DataFrame, eps: float, bands: int = 16, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs a < b within a cosine distance that share a bucket: near_pairs() but for recall, without all pairs. A band
    takes as many hyperplanes as give buckets of about `bucket_rows` vectors; a fuller one is cut by a hash into cells
    of that size, and two of its vectors meet in the cell of either's pair of cells, so none is lost. The distance is
    checked in the join's task."""
    n = vectors.count()
    rows = max(4, math.ceil(math.log2(max(1, n) / bucket_rows)))
    one = materialize(lsh_buckets(vectors, bands * rows, bands, seed), "buckets")
    cells = one.groupBy("bucket").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("cells"))
    cut = one.join(cells, "bucket").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    # cell pairs (i, j), i <= j: a vector of cell c is sent to all pairs with c
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    sent = cut.withColumn("other", other).select("bucket", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "id")
    sent = sent.join(_keyed(vectors), "id")
    schema = "a string, b string"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        side, i, j = t.column("cell").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        for _, (names, m) in _units(by_length(np.arange(t.num_rows), t.column("v").combine_chunks())).items():
            ids = np.array(t.column("id").take(names).to_pylist(), object)
            left, right = np.flatnonzero(side[names] == i), np.flatnonzero(side[names] == j)
            r, c = np.nonzero(1 - m[left] @ m[right].T <= eps + 1e-12)
            a, b = ids[left[r]], ids[right[c]]
            a, b = np.where(a < b, a, b), np.where(a < b, b, a)
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.string()), pa.array(b[keep], pa.string())], names=["a", "b"])

    return sent.groupBy("bucket", "i", "j").applyInArrow(meet, schema).distinct()


def near_pairs(vectors: DataFrame, eps: float) -> DataFrame:
    """Pairs a < b within a cosine distance, exactly."""

    def ask(shard: Rows, asked: Rows, _: list) -> Iterator[pa.RecordBatch]:
        for n, (names, q) in _units(asked).items():
            if n not in shard:
                continue
            ids, m = shard[n]
            for rows in _tiles(len(q), len(m)):
                r, c = np.nonzero(1 - q[rows] @ m.T <= eps + 1e-12)
                r += rows.start
                keep = names[r] < ids[c]
                yield pa.RecordBatch.from_arrays([pa.array(names[r][keep], pa.string()), pa.array(ids[c][keep], pa.string())], names=["a", "b"])

    rows = _keyed(vectors)
    return against_shards(rows, rows, _units, ask, "a string, b string")


def dbscan(vectors: DataFrame, eps: float = 0.3, min_points: int = 3, pairs: DataFrame | None = None) -> DataFrame:
    """method_id and cluster (its smallest core id) of clustered vectors. Neighbours are others within `eps`; a core has
    `min_points` of them; cores that are neighbours share a cluster; a border takes the smallest of its cores'."""
    pairs = materialize(near_pairs(vectors, eps) if pairs is None else pairs, "pairs")
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    core = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("id")
    ends = lambda d, c: d.join(core.withColumnRenamed("id", c), c, "left_semi")
    linked = components(ends(ends(pairs, "a"), "b"))
    rooted = core.join(linked.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    first = rooted.groupBy("root").agg(F.min("id").alias("cluster"))
    cores = rooted.join(first, "root").select("id", "cluster")
    touching = both.join(cores.select(F.col("id").alias("b"), "cluster"), "b").join(core.withColumnRenamed("id", "a"), "a", "left_anti")
    return cores.union(touching.groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))).select(F.col("id").alias("method_id"), "cluster")


def number_clusters(members: DataFrame) -> DataFrame:
    """cluster, cluster_id (cluster-N, the largest first; ties: smaller first member) and member_count. Sizes are few
    however many clusters there are; clusters are numbered within theirs, after all those of greater sizes."""
    sizes = materialize(members.groupBy("cluster").agg(F.count("*").alias("member_count")), "cluster-sizes")
    per = sizes.groupBy("member_count").agg(F.count("*").alias("n"))
    before = per.select("member_count", (F.sum("n").over(W.orderBy(F.desc("member_count"))) - F.col("n")).alias("before"))  # a row for each distinct size
    place = F.row_number().over(W.partitionBy("member_count").orderBy("cluster")) - 1
    return sizes.withColumn("place", place).join(before, "member_count").select("cluster", "member_count", F.concat(F.lit("cluster-"), F.col("before") + F.col("place")).alias("cluster_id"))


def cohesion(vectors: DataFrame, members: DataFrame, key: str = "cluster") -> DataFrame:
    """Mean pairwise cosine within clusters, in closed form from the sum of unit vectors; 1 for a single member."""
    v = F.col("vector").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.join(members, "method_id").select(key, "method_id", F.posexplode(F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))).alias("i", "x"))
    sums = unit.groupBy(key, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    out = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.max("n").alias("n"))
    mean = F.when(F.col("n") > 1, (F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    return out.select(key, F.round(mean, 6).alias("cohesion"))


def cluster_labels(members: DataFrame, key: str = "cluster") -> DataFrame:
    """A label for each cluster from its members' ids: most frequent verb and noun and most frequent container, case
    ignored, ties to the first in order; clusters of tests only are called unit tests of what they test."""
    m = members.select(key, F.col("method_id").alias("id"), short_name(F.col("method_id")).alias("short"), container_name(F.col("method_id")).alias("place"))
    seg = pascal_split(F.col("short"))
    known = lambda s: F.lower(s).isin(*STOPWORDS)
    noun = F.get(F.filter(F.slice(seg, 2, 1000), lambda s: ~known(s) & (F.length(s) > 2)), F.lit(0))
    verb = F.when(~known(F.get(seg, F.lit(0))) & (F.length(F.get(seg, F.lit(0))) > 1), F.get(seg, F.lit(0)))
    test = F.exists(seg, lambda s: F.lower(s).isin(*TEST_WORDS)) | F.col("id").ilike("%Tests.%") | F.col("id").ilike("%Test.%")
    m = m.withColumn("verb", verb).withColumn("noun", F.when(F.col("verb").isNotNull() & (F.size(seg) > 1), noun)).withColumn("is_test", test)
    best = lambda rows, by, out: rows.groupBy(key, *[F.lower(c).alias(f"k_{c}") for c in by]).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in by]).groupBy(key).agg(F.max_by(F.struct("n", *by), F.struct(F.col("n"), *[_reverse(F.col(c)) for c in by])).alias(out))
    pairs = best(m.where("noun is not null"), ["verb", "noun"], "p")
    places = best(m.where("place <> ''"), ["place"], "s")
    verbs = best(m.where("noun is not null").select(key, "verb", F.lower("noun")).distinct(), ["verb"], "v")
    all_ = m.groupBy(key).agg(F.min("is_test").alias("tests"), F.count("*").alias("size"))
    rows = all_.join(pairs, key, "left").join(places, key, "left").join(verbs, key, "left")
    place, pair = F.col("s.place"), F.concat_ws(" ", "p.verb", "p.noun")
    subject = F.regexp_replace(F.coalesce(place, F.lit("")), "Tests|Test", "")
    label = (
        F.when(F.col("tests") & (F.col("size") > 1), F.when(subject != "", F.concat(subject, F.lit(" unit tests"))).otherwise("unit tests"))
        .when(F.col("p.n") >= 2, F.when(place.isNotNull() & ~F.contains(F.lower(pair), F.lower(place)), F.concat(place, F.lit(" "), F.lower(pair), F.lit(" operations"))).otherwise(F.concat(pair, F.lit(" operations"))))
        .when(F.col("v.verb").isNotNull() & place.isNotNull(), F.concat(place, F.lit(" "), F.lower("v.verb"), F.lit(" operations")))
        .when(F.col("v.verb").isNotNull(), F.concat("v.verb", F.lit(" operations")))
        .when(place.isNotNull(), F.concat(place, F.lit(" operations"))).otherwise("miscellaneous")
    )
    return rows.select(key, label.alias("label"))


def _reverse(c: Column) -> Column:
    """A key that orders strings downwards, so that of equal counts the first string is the greatest."""
    return F.transform(F.split(F.lower(c), ""), lambda s: -F.ascii(s))


def search_tokens(spark: SparkSession, cells: DataFrame, query: str, k: int = 10, threshold: float = 0.5, dims: int = DIMS) -> DataFrame:
    """Texts nearest a query under the hash embedding: the k best by dot product, then those of at least `threshold`."""
    q = hash_embedding(spark.createDataFrame([("q", query)], "id string, text string"), "id", "text", dims).select("idx", F.col("val").alias("w"))
    score = cells.join(F.broadcast(q), "idx").groupBy("id").agg(F.round(F.sum(F.col("val") * F.col("w")), 6).alias("score"))  # at most `dims` cells
    return score.orderBy(F.desc("score"), "id").limit(k).where(F.col("score") >= threshold)
