"""Level-prefixed hierarchy files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from fenloom.operators.ordering import forward_fill
from fenloom.sources.sequences import numbered_lines

# The line prefixes of the four levels, outermost first.
LEVELS = ("A", "B", "C", "D")


def parse_htext(lines: DataFrame, levels: Sequence[str] = LEVELS, file: str = "file", **kw) -> DataFrame:
    """One row per leaf line with its ancestors as L1..L4; ``lines`` has (``file``, line_no, line)."""
    text = F.trim(F.regexp_replace(F.expr("substring(line, 2)"), "<[^>]*>", ""))
    kept = lines.filter(~F.col("line").rlike("^[#!+%]") & (text != ""))
    tag = F.substring("line", 1, 1)
    named = kept.select(file, "line_no", tag.alias("tag"), *[
        F.when(tag == lv, text).alias(f"L{n}") for n, lv in enumerate(levels, start=1)])
    upper = [f"L{n}" for n in range(1, len(levels))]
    filled = forward_fill(named, upper, [file], "line_no", **kw)
    return filled.filter(F.col("tag") == levels[-1]).select(file, "line_no", *upper, f"L{len(levels)}")


def read_htext(spark: SparkSession, path, levels: Sequence[str] = LEVELS) -> DataFrame:
    return parse_htext(numbered_lines(spark, path), levels, "path")
