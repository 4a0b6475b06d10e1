"""A strict comparison: names, kinds of type, row count, and values after sorting."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def make_session(partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("fenloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _kind(series: pd.Series) -> str:
    k = series.dtype.kind
    if k == "O":
        first = next((v for v in series if v is not None and not (isinstance(v, float) and math.isnan(v))), None)
        if isinstance(first, bool):
            return "b"
        if isinstance(first, int):
            return "i"
        if isinstance(first, float):
            return "f"
        return "s"
    return "i" if k == "u" else ("s" if k not in "ifbM" else k)


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else the first difference."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"row count {len(got)} != {len(want)}"
    cols = sorted(got.columns)
    if len(got):
        for c in cols:
            a, b = _kind(got[c]), _kind(want[c])
            has_null = got[c].isna().any()
            if a != b and not (has_null and {a, b} <= {"i", "f"}) and not (got[c].isna().all()):
                return f"type of {c}: {a} ({got[c].dtype}) != {b} ({want[c].dtype})"

    def rows(df):
        out = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
        return sorted(out, key=lambda r: tuple((v is None, str(type(v).__name__), repr(v)) for v in r))

    a, b = rows(got), rows(want)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        sa, sb = set(a), set(b)
        return (f"{len(diff)} rows differ; cols {cols}; only spark {sorted(sa - sb, key=repr)[:3]}; "
                f"only sql {sorted(sb - sa, key=repr)[:3]}")
    return None


def moved_columns(df) -> list[str]:
    """The columns that go into each shuffle of a plan."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"^\(\d+\) Exchange *\nInput \[\d+\]: (.*)$", plan, re.M)
