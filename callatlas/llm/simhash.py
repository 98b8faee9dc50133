"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into two halves. Two fingerprints that differ in at most three bits have a half that differs in
at most one, so each half is indexed as it is and once for each of its bits taken out. Fingerprints meet in an
equality join on these signatures (of a signature with a bit taken out, those with the bit set meet those without) and
the full distance is checked inside the join. Only distinct fingerprints are indexed: exact copies cost nothing. A half
that more than HOT fingerprints share is cut further, so no signature gathers them all.
Components come from rounds of contraction along hashed minima, all in DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callatlas.llm.common import bound_arrow_batches, materialize, packed
from callatlas.operators.graph import components

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Rows of one fingerprint for each salt that they are spread over when groups are joined to rows.
HOT_ROWS = 100_000
#: Distinct fingerprints of one half beyond which its signatures are joined with those of the other half's quarters.
HOT = 2000
_HALF = 0xFFFFFFFF


def fingerprint(text: bytes | None) -> int:
    """64 bits over lower-cased (A-Z) words between spaces and the five control characters 9 to 13; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)  # big-endian
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, `h` (a hash of the text) and `fp`, the fingerprint as a signed long; null and empty texts: 0."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in b.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found)], names=["doc_id", "h", "fp"])

    text = F.col("text").cast("string")
    return docs.select(text.cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints `fp` that differ in 1 to `max_distance` (at most 3) bits."""
    if not 0 < max_distance <= 3:
        raise ValueError("two segments find distances of 1 to 3")
    halves = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.expr(e).alias("half")) for k, e in enumerate((f"fp & {_HALF}", "shiftrightunsigned(fp, 32)"))])).alias("x")).select("fp", "x.which", "x.half")
    # variant 0..31 of a half: that bit taken out; 32: the half as it is
    one = halves.select("fp", "which", F.explode(F.expr("sequence(0, 32)")).alias("bit"), "half")
    taken, side = F.expr("case when bit < 32 then half & ~shiftleft(1L, bit) else half end"), F.expr("case when bit < 32 then shiftright(half, bit) & 1L end")
    one = one.select("fp", ((F.col("which") * 33 + F.col("bit")).cast("long") * (1 << 32) + taken).alias("signature"), side.alias("side"))
    hot = materialize(halves.groupBy("which", "half").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("which", "half"), "hot-halves")
    if hot.isEmpty():
        return _met(one, ["signature"], max_distance)
    bad = hot.select(F.col("which"), F.explode(F.expr("sequence(0, 32)")).alias("bit"), "half").select(((F.col("which") * 33 + F.col("bit")).cast("long") * (1 << 32) + taken).alias("signature")).distinct()
    cold = one.join(bad, "signature", "left_anti").select("fp", "signature", "side")
    # under a hot signature of one half the other one, which differs in at most three bits, has a quarter that differs in
    # at most one: these rows meet in the signature together with a variant of a quarter
    one = one.join(bad, "signature", "left_semi").select("fp", "signature", "side", F.explode(F.expr("sequence(0, 33)")).alias("q"))
    other = F.expr(f"case when signature >= {33 << 32} then fp & {_HALF} else shiftrightunsigned(fp, 32) end")
    quarter = one.withColumn("quarter", F.when(F.col("q") < 17, other.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned(other, 16))).withColumn("bit", F.expr("q % 17"))
    fine = quarter.select("fp", "signature", "side", (F.col("q").cast("long") * (1 << 16) + F.expr("case when bit < 16 then quarter & ~shiftleft(1L, bit) else quarter end")).alias("fine"), F.expr("case when bit < 16 then shiftright(quarter, bit) & 1L end").alias("fine_side"))
    return _met(cold, ["signature"], max_distance).union(_met(fine, ["signature", "fine"], max_distance)).distinct()


def _met(one: DataFrame, keys: list[str], max_distance: int) -> DataFrame:
    """Pairs of fingerprints with equal keys, checked in the join. Of a signature with a bit taken out, those with the
    bit set meet those without; of one without, all meet all others, once."""
    left = one.where("side is null or side = 0").select(*keys, F.col("fp").alias("x"), F.col("side").alias("side_x"), *([F.col("fine_side").alias("fine_x")] if "fine" in keys else []))
    right = one.where("side is null or side = 1").select(*[F.col(k).alias(f"same_{k}") for k in keys], F.col("fp").alias("y"), *([F.col("fine_side").alias("fine_y")] if "fine" in keys else []))
    meet = " and ".join(f"{k} = same_{k}" for k in keys) + f" and (side_x is not null or x < y) and bit_count(x ^ y) between 1 and {max_distance}"
    if "fine" in keys:
        meet += " and (fine_x is null or fine_x <> fine_y)"
    # signatures are many times the fingerprints that sizes are estimated by: never broadcast
    return left.join(right.hint("merge"), F.expr(meet)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _grouped(docs: DataFrame, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """fingerprints() of all rows; and of every fingerprint its root, component_id, first row and number of rows."""
    rows = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first"), F.count("*").alias("n")), "distinct")
    labels = components(links(distinct, max_distance))
    rooted = distinct.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows, rooted.join(least, "root").select("fp", "root", "component_id", "first", "n")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row.

    Rows without words have fingerprint zero and link like any other; rows with equal fingerprints are linked; a null
    doc_id takes part but never names a component unless it has no other id (then component_id is null).
    """
    rows, of = _grouped(docs, max_distance)
    of = of.select("fp", "component_id", (F.col("n") / HOT_ROWS).cast("int").alias("more"))
    hot = materialize(of.where("more > 0"), "hot-fingerprints")
    if hot.isEmpty():
        joined = rows.join(of, "fp", "left")
    else:  # rows of a hot fingerprint are spread over `more` + 1 salts; there are at most rows / HOT_ROWS of these
        salted = rows.join(F.broadcast(hot.select("fp", F.col("more").alias("salts"))), "fp", "left").withColumn("salt", F.coalesce((F.monotonically_increasing_id() % (F.col("salts") + 1)).cast("int"), F.lit(0)))
        joined = salted.join(of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("more")))), ["fp", "salt"], "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of docs, all columns whatever their names, for each group of near-duplicates: that of the smallest
    doc_id, rows without one last; of several rows with that id, one by a hash of its text and, of equal texts, any.

    So exactly one row of each group stays: repeated rows, also those without doc_id, are duplicates of each other, and
    rows that share a doc_id but not their group are kept apart.
    """
    rows, of = _grouped(docs, max_distance)
    chosen = materialize(of.groupBy("root").agg(F.min("first").alias("m")).select("m.doc_id", "m.h"), "chosen")
    same = materialize(rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "h"), "repeated")
    source = packed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("h"))
    is_ = lambda other: source["doc_id"].eqNullSafe(other["doc_id"]) & (source["h"] == other["h"])
    chosen = chosen.hint("merge")  # it grows with the rows: never broadcast
    stay = source.join(chosen, is_(chosen), "left_semi")
    if same.isEmpty():
        return stay.select("row.*")
    again = lambda d, how: d.join(same, d["doc_id"].eqNullSafe(same["doc_id"]) & (d["h"] == same["h"]), how)
    return again(stay, "left_anti").select("row").union(again(stay, "left_semi").dropDuplicates(["doc_id", "h"]).select("row")).select("row.*")
