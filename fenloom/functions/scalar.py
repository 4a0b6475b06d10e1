"""Column functions.  All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Ranks of a lineage string, in order.
RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_suffix(col, pattern: str) -> Column:
    """Remove a regex anchored at the end of the text."""
    return F.regexp_replace(_c(col), f"(?:{pattern})$", "")


def detect(col, pattern: str, ignore_case: bool = False) -> Column:
    return _c(col).rlike(("(?i)" if ignore_case else "") + pattern)


def first_word(col) -> Column:
    return F.substring_index(_c(col), " ", 1)


def paste(*cols, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[_c(c) for c in cols])


def wrap(col, width: int) -> Column:
    """Break text at blanks so that lines hold at most ``width`` characters."""
    return F.regexp_replace(_c(col), f"(.{{1,{width}}})( +|$)", "$1\n")


def round_even(col, digits: int = 0) -> Column:
    return F.bround(_c(col), digits)


def back_transform(intercept, coef=None, scale: float = 1.0) -> Column:
    """Log-link coefficient(s) to the response scale."""
    value = F.exp(_c(intercept))
    if coef is not None:
        value = value * F.exp(_c(coef))
    return value * F.lit(scale)


def label_null(col, label: str) -> Column:
    return F.coalesce(_c(col), F.lit(label))


def case_when(*branches: tuple[Column, object], otherwise=None) -> Column:
    """First matching branch wins; no match gives NULL unless ``otherwise`` is set."""
    out = None
    for cond, value in branches:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def recode(col, mapping: Mapping) -> Column:
    """Exact-value recode; values outside the mapping become NULL."""
    return case_when(*[(_c(col) == F.lit(k), F.lit(v)) for k, v in mapping.items()])


def rate(after, before, elapsed) -> Column:
    return (_c(after) - _c(before)) / elapsed


def clean_text(col, sep_from: str = "\t", sep_to: str = ",") -> Column:
    """Drop carriage returns and swap the field separator."""
    return F.regexp_replace(F.regexp_replace(_c(col), "\r", ""), sep_from, sep_to)


def split_at(col, sep: str, n: int) -> tuple[Column, Column]:
    """The first ``n`` fields joined again, and the rest joined again."""
    parts = F.split(_c(col), F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E")))
    head = F.substring_index(_c(col), sep, n)
    tail = F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), sep)
    return head, tail


def parse_lineage(col, sep: str = ";") -> list[Column]:
    """Seven rank columns; a missing or blank rank is NULL."""
    parts = F.split(_c(col), sep)
    return [
        F.nullif(F.regexp_replace(F.trim(F.get(parts, i)), "^[a-z]__", ""), F.lit("")).alias(rank)
        for i, rank in enumerate(RANKS)
    ]


def cast_schema(df: DataFrame, schema: T.StructType | Mapping[str, str]) -> DataFrame:
    """Cast named columns; unreadable values become NULL."""
    if isinstance(schema, T.StructType):
        schema = {f.name: f.dataType.simpleString() for f in schema.fields}
    return df.withColumns({k: F.col(f"`{k}`").try_cast(v) for k, v in schema.items()})


def kmers(text, k: int) -> Column:
    """All overlapping substrings of length ``k``; an empty array for short text."""
    t = _c(text)
    n = F.length(t) - (k - 1)
    return F.when(
        n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.substring(t, p, F.lit(k)))
    ).otherwise(F.array().cast("array<string>"))


def hash32(*parts, sep: str = "|") -> Column:
    """Uniform integer in [0, 2^32): the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(sep, *parts)), 1, 8), 16, 10).cast("bigint")
