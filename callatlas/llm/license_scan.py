"""License notices in texts: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are lower-cased runs of ASCII digits, letters and non-ASCII characters; a shingle is five of them, hashed. A
template of n shingles is looked for in windows of its size class: windows as long as the class's longest template,
a quarter of its shortest apart. With bands of one row a window and a template collide in one of BANDS bands with
probability 1 - (1 - J)^BANDS for their Jaccard similarity J, at least 1 - 2e-5 for J of 0.3. The bands are an index:
(size class, band, value) of a window is joined with those of the templates. A window collides in a band only if it
holds the very shingle that has the template's minimum there, so texts, sections and windows without any such shingle
are passed over, at no loss. Candidates are verified by exact containment of the template's shingles in the window.
Texts are cut into overlapping sections first, so the work is linear in their length. Only DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callatlas.llm.common import materialize

SHINGLE = 5
BANDS = 32
MIN_CONTAINMENT = 0.8
#: Templates of a pass: their anchor shingles are part of the plan; more take several passes.
PASS_TEMPLATES = 500
#: Shingles of a section of a text, at least.
SECTION = 4096
#: Customary notices of public licences.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def words(text: Column) -> Column:
    """Words of a text; none of a null or empty one."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words of a text, in order; none if there are fewer words. The words are bound to
    a lambda variable, so that a text is split once and not once for each shingle."""
    return F.get(F.transform(F.array(words(text)), _runs), F.lit(0))


def _runs(w: Column) -> Column:
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def _template_hashes(spark: SparkSession, templates: dict[str, str]) -> dict[str, list[int]]:
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    return {r[0]: list(dict.fromkeys(r[1])) for r in rows.select("license", shingles(F.col("text"))).collect() if r[1]}


def _minima(spark: SparkSession, hashes: dict[str, list[int]], bands: int) -> list[tuple[str, int, int, int]]:
    """License, band, the smallest band hash of its shingles, and the shingle that has it."""
    rows = spark.createDataFrame([(k, h) for k, hs in hashes.items() for h in hs], "license string, h bigint")
    keyed = rows.select("license", "h", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).withColumn("v", F.xxhash64("h", "band"))
    return [tuple(r) for r in keyed.groupBy("license", "band").agg(F.min(F.struct("v", "h")).alias("m")).select("license", "band", "m.v", "m.h").collect()]


def _bigints(values) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, least: float = MIN_CONTAINMENT) -> DataFrame:
    """doc_id, license, containment (the greatest of a window), first_word (from 0, of the first window with it) and
    n_windows (places of verified ones) of each document and license notice in it.

    Null and short texts have no shingles; templates of fewer than five words are never found; a doc_id of several rows
    counts as one document, a null one as another; other columns are ignored.
    """
    spark = docs.sparkSession
    hashes = _template_hashes(spark, NOTICES if templates is None else templates)
    names = sorted(hashes)
    found = [_pass(docs, {n: hashes[n] for n in names[k : k + PASS_TEMPLATES]}, bands, least) for k in range(0, len(names), PASS_TEMPLATES)]
    if not found:
        return spark.createDataFrame([], "doc_id bigint, license string, containment double, first_word bigint, n_windows bigint")
    return reduce(DataFrame.union, found)


def _window(width: int, step: int, pad: int):
    """The window that begins at a place, from the section's `part`, which begins up to `pad` before column `at`. It
    lies up to a step away from the notice, so `near` has a step more on both sides for verification."""

    def at(i: Column) -> Column:
        inside = i - F.greatest(F.lit(0), F.col("at") - pad)
        near = F.slice("part", F.greatest(F.lit(1), inside - step + 1), F.least(inside, F.lit(step)) + width + step)
        return F.struct(i.cast("long").alias("at"), F.slice("part", inside + 1, F.lit(width)).alias("w"), near.alias("near"))

    return at


def _pass(docs: DataFrame, hashes: dict[str, list[int]], bands: int, least: float) -> DataFrame:
    spark = docs.sparkSession
    minima = _minima(spark, hashes, bands)
    classes = {n: (len(hs) - 1).bit_length() for n, hs in hashes.items()}
    longest = {c: 1 << c for c in classes.values()}
    step = {c: max(1, (w // 2 + 1) // 4) for c, w in longest.items()}
    section, pad = max(SECTION, *longest.values()), max(step.values())  # powers of two, so steps go on over sections
    margin = max(longest.values()) + pad
    anchors = {c: _bigints(sorted({m[3] for m in minima if classes[m[0]] == c})) for c in longest}
    every = _bigints(sorted({m[3] for m in minima}))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingles(F.col("text").cast("string")).alias("s")).where(F.arrays_overlap("s", every))
    # a section holds the windows that begin in it, `pad` shingles before and `margin` after
    cut = lambda i: F.struct(i.alias("at"), F.slice("s", F.greatest(F.lit(1), i - pad + 1), section + margin + F.least(i, F.lit(pad))).alias("part"))
    sections = base.select("doc_id", F.size("s").alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(section)), cut)).alias("c"))
    sections = sections.select("doc_id", "n", "c.at", "c.part").where(F.arrays_overlap("part", every))
    sections = materialize(sections, "license-sections")  # the few with an anchor; keeps the rest of the plan small
    index = spark.createDataFrame([(classes[n], b, v, n) for n, b, v, _ in minima], "size int, band int, v bigint, license string")
    notices = spark.createDataFrame([(n, hs) for n, hs in hashes.items()], "license string, t array<bigint>")
    windows = []
    for c, width in sorted(longest.items()):
        last = F.least(F.col("at") + section - 1, F.greatest(F.lit(0), F.col("n") - width + step[c] - 1))
        places = F.when(last >= F.col("at"), F.sequence(F.col("at"), last, F.lit(step[c]))).otherwise(F.array().cast("array<int>"))
        here = sections.where(F.arrays_overlap("part", anchors[c])).select("doc_id", F.explode(F.transform(places, _window(width, step[c], pad))).alias("x"))
        windows.append(here.select("doc_id", F.lit(c).alias("size"), "x.at", "x.w", "x.near").where(F.arrays_overlap("w", anchors[c])))
    sketch = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform("w", lambda h: F.xxhash64(h, b))))
    keyed = reduce(DataFrame.union, windows).select("doc_id", "size", "at", "near", F.posexplode(sketch).alias("band", "v"))
    met = keyed.join(F.broadcast(index), ["size", "band", "v"]).join(F.broadcast(notices), "license")  # PASS_TEMPLATES templates at most
    share = F.size(F.array_intersect("near", "t")) / F.size("t")
    sure = met.select("doc_id", "license", "at", share.alias("containment")).where(F.col("containment") >= least).groupBy("doc_id", "license", "at").agg(F.max("containment").alias("containment"))
    best = F.max(F.struct("containment", (-F.col("at")).alias("neg")))
    return sure.groupBy("doc_id", "license").agg(best.alias("best"), F.count("*").alias("n_windows")).select("doc_id", "license", "best.containment", (-F.col("best.neg")).alias("first_word"), "n_windows")
