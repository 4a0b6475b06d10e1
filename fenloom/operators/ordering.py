"""Exact order statistics that never put a whole group into one task.

The rows of a group are cut into value ranges; each range is sorted on its own and
starts from the totals of the ranges before it.  Equal values are collapsed to one
weighted row first, so a value shared by most rows costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenloom.session import cut_lineage, pieces

ROWS_PER_RANGE = 1_000_000


def with_ranges(df: DataFrame, order: str, ranges: int | None = None) -> tuple[DataFrame, int]:
    """Add ``_range``, an integer growing with ``order``; equal values share a range.

    Rows are range-partitioned by Spark and written, so that a range is the partition a row
    fell into and stays so; no edges reach the driver or an expression.
    """
    if ranges is None:
        ranges = pieces(df.count(), ROWS_PER_RANGE)
    if ranges <= 1:
        return df.withColumn("_range", F.lit(0)), 1
    placed = df.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id())
    return cut_lineage(placed, "ranges"), ranges


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    weight: str,
    out: str = "running",
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """One row per (by, order value): its weight and the inclusive running total."""
    by = list(by)
    # collapsed rows are read several times (count, range edges, sums): write them once
    per = cut_lineage(df.groupBy(*by, order).agg(F.sum(weight).alias(weight)))
    per, n = with_ranges(per, order, ranges)
    key = F.col(order).desc() if descending else F.col(order).asc()
    if n == 1:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return per.withColumn(out, F.sum(weight).over(w)).drop("_range")
    rkey = F.col("_range").desc() if descending else F.col("_range").asc()
    # at most one row per range and group, so this window stays small
    before = Window.partitionBy(*by).orderBy(rkey).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per.groupBy(*by, "_range").agg(F.sum(weight).alias("_w"))
        .withColumn("_offset", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .drop("_w")
    )
    inner = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return (
        per.withColumn("_inner", F.sum(weight).over(inner))
        .join(offsets, [*by, "_range"])
        .withColumn(out, F.col("_inner") + F.col("_offset"))
        .drop("_range", "_inner", "_offset")
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float], ranges: int | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group, one output column per name in ``probs``."""
    by = list(by)
    cum = running_total(
        df.filter(F.col(col).isNotNull()).select(*by, col, F.lit(1).cast("bigint").alias("_n")),
        by, col, "_n", "_cum", ranges=ranges,
    )
    totals = df.filter(F.col(col).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    joined = cum.join(totals, by) if by else cum.withColumn("n", totals.scalar())
    v, first, last = F.col(col), F.col("_cum") - F.col("_n"), F.col("_cum")
    aggs: list[Column] = [F.first("n").alias("n"), F.min(v).alias("min"), F.max(v).alias("max")]
    for name, p in probs.items():
        lo = F.floor((F.col("n") - 1) * F.lit(p))
        hi = F.ceil((F.col("n") - 1) * F.lit(p))
        aggs.append(F.max(F.when((first <= lo) & (lo < last), v)).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((first <= hi) & (hi < last), v)).alias(f"_hi_{name}"))
    wide = joined.groupBy(*by).agg(*aggs)
    cols = [*by, "n", "min", "max"]
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(p)
        cols.append(
            (F.col(f"_lo_{name}") + (h - F.floor(h)) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name)
        )
    return wide.select(*cols)


def average_rank(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "rank",
                 ranges: int | None = None) -> DataFrame:
    """Rank of each row within its group, ties sharing their mean rank."""
    by = list(by)
    cum = running_total(df.select(*by, col, F.lit(1).cast("bigint").alias("_n")), by, col, "_n", "_cum",
                        ranges=ranges)
    ranks = cum.select(
        *by, col, (F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)).alias(out)
    )
    return df.join(ranks, [*by, col])


def forward_fill(df: DataFrame, cols: Sequence[str], by: Sequence[str], order: str,
                 ranges: int | None = None) -> DataFrame:
    """Carry the last non-null value down in ``order``, within ``by``."""
    by = list(by)
    marked, n = with_ranges(df, order, ranges)
    inner = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if n == 1:
        return marked.withColumns({c: F.last(c, True).over(inner) for c in cols}).drop("_range")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*by, "_range").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in cols]
    )
    carried = carried.select(*by, "_range", *[F.last(f"_end_{c}", True).over(before).alias(f"_in_{c}") for c in cols])
    filled = marked.withColumns({c: F.last(c, True).over(inner) for c in cols}).join(carried, [*by, "_range"])
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_in_{c}")) for c in cols}).drop(
        "_range", *[f"_in_{c}" for c in cols]
    )


def suffix_min(df: DataFrame, by: Sequence[str], order: str, value: str, out: str,
               ranges: int | None = None) -> DataFrame:
    """Smallest ``value`` among rows at or after each row in ``order``, within ``by``."""
    by = list(by)
    ranged, n = with_ranges(df, order, ranges)
    inner = Window.partitionBy(*by, "_range").orderBy(F.col(order).desc()).rangeBetween(Window.unboundedPreceding, 0)
    if n == 1:
        return ranged.withColumn(out, F.min(value).over(inner)).drop("_range")
    later = Window.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*by, "_range").agg(F.min(value).alias("_v")).select(
        *by, "_range", F.min("_v").over(later).alias("_after"))
    return (
        ranged.withColumn("_in", F.min(value).over(inner)).join(ends, [*by, "_range"])
        .withColumn(out, F.least("_in", "_after")).drop("_in", "_after", "_range")
    )


def next_value(df: DataFrame, by: Sequence[str], order: str, out: str, ranges: int | None = None) -> DataFrame:
    """The following ``order`` value within ``by``, NULL on the last row.

    Rows are expected to be distinct in (by, order).
    """
    by = list(by)
    ranged, n = with_ranges(df, order, ranges)
    inner = Window.partitionBy(*by, "_range").orderBy(order)
    if n == 1:
        return ranged.withColumn(out, F.lead(order).over(inner)).drop("_range")
    firsts = ranged.groupBy(*by, "_range").agg(F.min(order).alias("_first"))
    after = firsts.select(*by, "_range", F.lead("_first").over(Window.partitionBy(*by).orderBy("_range")).alias("_after"))
    return (
        ranged.withColumn("_lead", F.lead(order).over(inner)).join(after, [*by, "_range"])
        .withColumn(out, F.coalesce("_lead", "_after")).drop("_lead", "_after", "_range")
    )
