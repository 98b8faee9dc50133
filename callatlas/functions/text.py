"""Column expressions over names, paths and source text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"(\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+|[0-9]+)"
#: Characters that separate tokens of a structural signature.
SIGNATURE_SEPARATORS = r"[ (){};,\n\r\t]+"


def contains(column: Column | str, part: str) -> Column:
    """LIKE %part%, case-insensitive; % and _ in `part` stay wildcards."""
    return (F.col(column) if isinstance(column, str) else column).ilike(f"%{part}%")


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob with * and ?; case doesn't matter."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob(column: Column | str, pattern: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).rlike(glob_regex(pattern))


def bare_name(full_name: Column) -> Column:
    """Without parameters and return type."""
    return F.element_at(F.split(F.substring_index(full_name, "(", 1), " "), -1)


def group_key(full_name: Column, level: str = "namespace") -> Column:
    """Type or namespace part of a full name: the last one or two dotted parts dropped."""
    parts = F.split(bare_name(full_name), r"\.")
    drop = {"type": 1, "namespace": 2}[level]
    return F.when(F.size(parts) > drop, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - drop), ".")).otherwise(F.lit(""))


def short_name(method_id: Column) -> Column:
    return F.substring_index(F.substring_index(method_id, "(", 1), ".", -1)


def container_name(method_id: Column) -> Column:
    parts = F.split(F.substring_index(method_id, "(", 1), r"\.")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))


def tail_name(full_name: Column) -> Column:
    """Type.Method."""
    return F.substring_index(bare_name(full_name), ".", -2)


def tokenize(name: Column) -> Column:
    """Identifier tokens: at underscores, lower to upper case, before an acronym's last capital, around digits."""
    return F.regexp_extract_all(name, F.lit(_TOKEN), 1)


def tokenize_lower(name: Column) -> Column:
    return F.transform(tokenize(name), F.lower)


def pascal_split(name: Column) -> Column:
    return F.split(name, r"(?<=.)(?=\p{Lu})")


def signature_tokens(signature: Column) -> Column:
    return F.filter(F.split(signature, SIGNATURE_SEPARATORS), lambda t: t != "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_type(name: Column) -> Column:
    """Type name without array marks, nullability, generic arguments and namespace."""
    plain = F.substring_index(F.regexp_replace(name, r"\[\]|\?", ""), "<", 1)
    return F.substring_index(plain, ".", -1)


def semantic_payload(name: Column, parameter_types: Column, return_type: Column, called: Column, literals: Column) -> Column:
    """Distinct lower-case tokens, in order, of a method's name, types, called names and string literals."""
    words = lambda c: F.flatten(F.transform(c, tokenize_lower))
    typed = F.transform(parameter_types, clean_type)
    result = F.when(F.lower(return_type) == "void", F.array().cast("array<string>")).otherwise(F.array(clean_type(return_type)))
    said = F.flatten(F.transform(F.filter(literals, lambda s: F.length(s) <= 100), lambda s: F.transform(F.regexp_extract_all(s, F.lit("([0-9A-Za-z]{2,})"), 1), F.lower)))
    return F.array_join(F.array_distinct(F.concat(tokenize_lower(name), words(typed), words(result), words(called), said)), " ")


def lines_of_code(source: Column) -> Column:
    """Lines that are neither blank nor only comment; block comments may span lines."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"))

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(line)
        after = F.when(acc["inside"], F.when(F.contains(t, F.lit("*/")), F.trim(F.regexp_replace(t, r"^.*?\*/", ""))).otherwise(F.lit(""))).otherwise(t)
        open_ = after.startswith("/*") & ~F.contains(after, F.lit("*/"))
        rest = F.when(after.startswith("/*"), F.trim(F.regexp_replace(after, r"^/\*.*?(\*/|$)", ""))).otherwise(after)
        code = (rest != "") & ~rest.startswith("//")
        still = acc["inside"] & ~F.contains(t, F.lit("*/"))
        return F.struct((acc["n"] + code.cast("int")).alias("n"), (still | open_).alias("inside"))

    return F.aggregate(F.split(F.coalesce(source, F.lit("")), r"\r?\n"), start, step)["n"]


def risk(complexity: Column, blast_radius: Column) -> Column:
    return complexity * (1 + F.log1p(blast_radius))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def age_bucket(then: Column, now: Column) -> Column:
    days = F.datediff(now, then)
    return (
        F.when(days < 1, "today").when(days < 2, "1d").when(days < 30, F.concat(days, F.lit("d")))
        .when(days < 365, F.concat(F.floor(days / 30), F.lit("mo"))).otherwise(F.concat(F.floor(days / 365), F.lit("y")))
    )


def kind_tag(kind: Column) -> Column:
    return F.lower(kind)


def visibility_tag(accessibility: Column) -> Column:
    return F.when(accessibility == "Public", "+").when(accessibility == "Private", "-").when(accessibility == "Protected", "#").otherwise("~")


def csv_column(value: Column) -> Column:
    """As csv_field(), for a column; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_field(value: str) -> str:
    """A value for a CSV line: quoted if it holds a comma, a quote or a line break."""
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n\r') else value
