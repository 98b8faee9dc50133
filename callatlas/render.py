"""Output of bounded results: compact lines, tables, JSON and CSV."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from callatlas.functions.text import csv_field

FORMATS = ("compact", "table", "json", "csv")


def render(df: DataFrame, form: str = "compact", top: int = 100) -> str:
    """At most `top` rows of df as text, and how many more there are."""
    if form not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    found = df.limit(top + 1).collect()
    rows, more = found[:top], len(found) > top
    names = df.columns
    text = lambda v: "" if v is None else "|".join(map(str, v)) if isinstance(v, list) else str(v)
    if form == "json":
        return json.dumps({"items": [r.asDict(True) for r in rows], "truncated": more}, indent=2, default=str)
    if form == "csv":
        return "\n".join([",".join(names), *(",".join(csv_field(text(v)) for v in r) for r in rows)])
    if form == "table":
        cells = [names, *[[text(v) for v in r] for r in rows]]
        widths = [max(len(c[k]) for c in cells) for k in range(len(names))]
        lines = ["  ".join(v.ljust(w) for v, w in zip(c, widths)).rstrip() for c in cells]
        lines.insert(1, "  ".join("-" * w for w in widths))
    else:
        lines = [" ".join(text(v) for v in r) for r in rows]
    return "\n".join([*lines, *(["+ more"] if more else [])])
