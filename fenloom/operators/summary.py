"""Grouped summaries.  Everything that can be a mergeable aggregate is one."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from fenloom.operators.ordering import exact_quantiles


def data_summary(df: DataFrame, var: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(var).alias("mean"), F.stddev_samp(var).alias("sd"))


def std_error(var) -> Column:
    return F.stddev_samp(var) / F.sqrt(F.count(var))


def summary_se(df: DataFrame, var: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(var).alias("n"), F.avg(var).alias("mean"), F.stddev_samp(var).alias("sd"),
        std_error(var).alias("se"),
    )


def group_mean(df: DataFrame, var: str, by: Sequence[str], out: str = "mean") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(var).alias(out))


def attach_group_mean(df: DataFrame, var: str, by: Sequence[str], out: str = "group_mean") -> DataFrame:
    """Group mean next to every row: aggregate and join back, so that a large group
    is never gathered for a window."""
    return df.join(group_mean(df, var, by, out), list(by))


def add_count(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    return df.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias(out)), list(by))


def frequency(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def prob_direction(draws: DataFrame, by: Sequence[str], value: str = "value", positive: bool = True) -> DataFrame:
    hit = F.col(value) > 0 if positive else F.col(value) < 0
    return draws.groupBy(*by).agg(F.avg(hit.cast("double")).alias("pd"))


def summary6(df: DataFrame, var: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, mean and maximum."""
    q = exact_quantiles(df, by, var, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    m = df.groupBy(*by).agg(F.avg(var).alias("mean"))
    out = q.join(m, list(by)) if by else q.withColumn("mean", m.scalar())
    return out.select(*by, "min", "q1", "median", "mean", "q3", "max")


def box_stats(df: DataFrame, var: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends inside the 1.5 IQR fences, and the number outside."""
    q = exact_quantiles(df, by, var, {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(
        *by, "n", "q1", "median", "q3"
    )
    iqr = F.col("q3") - F.col("q1")
    fenced = q.withColumn("lo", F.col("q1") - 1.5 * iqr).withColumn("hi", F.col("q3") + 1.5 * iqr)
    inside = (F.col(var) >= F.col("lo")) & (F.col(var) <= F.col("hi"))
    return (
        df.select(*by, var).join(fenced, list(by))
        .groupBy(*by, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(var))).alias("whisker_low"),
            F.max(F.when(inside, F.col(var))).alias("whisker_high"),
            F.count(F.when(~inside, 1)).alias("n_outliers"),
        )
    )


def histogram(df: DataFrame, col: str, width: float) -> DataFrame:
    """Counts per left-closed bin."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.floor(F.col(col) / F.lit(width)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.col("bin") * F.lit(width))
    )


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations of all column pairs over complete rows, one pass."""
    pairs = list(combinations(cols, 2))
    complete = df.dropna(subset=list(cols))
    one = complete.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"_{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.explode(rows).alias("p")).select("p.x", "p.y", "p.r")


def lm_line(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def kde_grid(df: DataFrame, col: str, by: Sequence[str], points: int = 64) -> DataFrame:
    """Gaussian kernel density on an even grid over each group's range.

    Bandwidth is the usual rule of thumb 0.9 min(sd, IQR/1.34) n^(-1/5).  Each row
    is turned into its grid contributions where it lies, and only (group, grid
    point) sums are shuffled.
    """
    q = exact_quantiles(df, by, col, {"q1": 0.25, "q3": 0.75})
    sd = df.groupBy(*by).agg(F.stddev_samp(col).alias("sd"))
    spread = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / F.lit(1.34))
    spec = q.join(sd, list(by)).select(
        *by, F.col("n").alias("_n"), F.col("min").alias("_min"), F.col("max").alias("_max"),
        (F.lit(0.9) * F.when(spread > 0, spread).otherwise(F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0)))
         * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"),
    )
    step = (F.col("_max") - F.col("_min")) / F.lit(points - 1)
    at = F.col("_min") + F.col("k") * step
    z = (at - F.col(col)) / F.col("bw")
    # equal measurements give equal kernels, so collapse them first
    rows = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_w"))
    return (
        rows.join(spec, list(by))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(*by, "k", "_n", "_min", "_max", "bw")
        .agg(F.sum(F.col("_w") * F.exp(-0.5 * z * z)).alias("_s"))
        .select(*by, "k", at.alias("x"), "bw",
                (F.col("_s") / (F.col("_n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
    )


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / sd for each column; the one-row summary is a scalar subquery."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]
        ).alias("stats")
    )
    return (
        df.withColumn("_stats", stats.scalar())
        .withColumns({c: (F.col(c) - F.col(f"_stats.m_{c}")) / F.col(f"_stats.s_{c}") for c in cols})
        .drop("_stats")
    )
