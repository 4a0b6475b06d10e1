"""Filters, joins, reshapes and row-wise derivations on plain tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenloom.functions.scalar import detect


# ---- filters and projections -------------------------------------------------

def grep_filter(df: DataFrame, col: str, pattern: str, invert: bool = False,
                ignore_case: bool = False) -> DataFrame:
    hit = detect(col, pattern, ignore_case)
    return df.filter(~hit if invert else hit)


def select_matching(df: DataFrame, pattern: str, invert: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    rx = re.compile(pattern)
    return df.select(*[c for c in df.columns if c in keep or bool(rx.search(c)) != invert])


def drop_positions(df: DataFrame, *positions: int) -> DataFrame:
    return df.select(*[c for i, c in enumerate(df.columns) if i not in positions])


def clamp(df: DataFrame, cols: Sequence[str], lo: float = 0.0) -> DataFrame:
    """Raise values below ``lo``; NULL stays NULL."""
    return df.withColumns({c: F.when(F.col(c) < lo, F.lit(lo)).otherwise(F.col(c)) for c in cols})


def offset(df: DataFrame, cols: Sequence[str], by: float) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.lit(by) for c in cols})


def mask(df: DataFrame, cond: Column, cols: Sequence[str]) -> DataFrame:
    """Set ``cols`` to NULL where ``cond`` holds."""
    return df.withColumns({c: F.when(~F.coalesce(cond, F.lit(False)), F.col(c)) for c in cols})


def one_hot(df: DataFrame, col: str, levels: Sequence[str], prefix: str = "is_") -> DataFrame:
    return df.withColumns(
        {prefix + re.sub(r"\W+", "_", str(lv)).lower(): (F.col(col) == F.lit(lv)).cast("int") for lv in levels}
    )


def split_complete(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without, and rows with, a NULL in ``cols``."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return df.filter(ok), df.filter(~ok)


def mapped(alignments: DataFrame, flag: str = "flag") -> DataFrame:
    """Drop rows with the unmapped bit (4) set."""
    return alignments.filter(F.col(flag).bitwiseAND(4) == 0)


# ---- joins -------------------------------------------------------------------

def filter_by_ids(records: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return records.join(ids.select(on), on, "left_semi")


def order_like(df: DataFrame, other: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``other``, in the order of its position column."""
    return df.join(other.select(key, position), key).orderBy(position)


def compare_groups(agg: DataFrame, on: Sequence[str], group: str, levels: Sequence[str],
                   values: Sequence[str]) -> DataFrame:
    """Group aggregates side by side, matched on keys."""
    # conditional aggregates: one shuffle for any number of levels and values
    cols = [
        F.max(F.when(F.col(group) == F.lit(lv), F.col(v))).alias(f"{lv}_{v}") for lv in levels for v in values
    ]
    return agg.groupBy(*on).agg(*cols)


def ordinal_ids(df: DataFrame, key: str, prefix: str, out: str = "new_id") -> DataFrame:
    """Stable new ids (prefix + running number) in key order over the distinct keys.

    The numbering is done range by range: only one count per key range is ever
    gathered in one place.
    """
    keys = df.select(key).distinct()
    # the first two md5 digits split the keys evenly and are a prefix of the order
    h = F.md5(F.col(key).cast("string"))
    keys = keys.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    sizes = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))  # 256 rows at most
    inner = Window.partitionBy("_b").orderBy("_h")
    return (
        keys.withColumn("_rn", F.row_number().over(inner))
        .join(F.broadcast(starts), "_b")
        .select(key, F.concat(F.lit(prefix), (F.col("_start") + F.col("_rn")).cast("string")).alias(out))
    )


def remap_ids(df: DataFrame, mapping: DataFrame, key: str, new: str) -> DataFrame:
    return df.join(mapping, key).drop(key).withColumnRenamed(new, key)


def regroup(counts: DataFrame, mapping: DataFrame, feature: str = "feature_id", group: str = "group_id",
            unmapped: str = "UNGROUPED") -> DataFrame:
    """Sum features into groups (many-to-many); features without a group are kept together."""
    return (
        counts.join(mapping, feature, "left")
        .withColumn(group, F.coalesce(F.col(group), F.lit(unmapped)))
        .groupBy("sample_id", group)
        .agg(F.sum("abundance").alias("abundance"))
    )


# ---- sets and reshapes ---------------------------------------------------------

def stack(tables: Mapping[str, DataFrame], label: str) -> DataFrame:
    out = None
    for name, df in tables.items():
        df = df.withColumn(label, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def distinct_keys(tables: Sequence[DataFrame], key: str) -> DataFrame:
    out = tables[0].select(key)
    for df in tables[1:]:
        out = out.unionByName(df.select(key))
    return out.distinct()


def with_metadata(scores: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    return scores.join(samples, key)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], names: str, value: str, names_list: Sequence[str],
            fill: float | int | None = 0) -> DataFrame:
    """Long to wide with the column list given, so no extra job finds it."""
    out = df.groupBy(*ids).pivot(names, list(names_list)).agg(F.sum(value))
    return out if fill is None else out.fillna(fill, subset=[str(n) for n in names_list])


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str) -> DataFrame:
    parts = F.split(F.col(col), re.escape(sep))
    return df.withColumns({name: F.get(parts, i) for i, name in enumerate(into)}).drop(col)


def unite(df: DataFrame, new: str, cols: Sequence[str], sep: str = "_") -> DataFrame:
    return df.withColumn(new, F.concat_ws(sep, *[F.col(c) for c in cols]))


# ---- order ---------------------------------------------------------------------

def arrange(df: DataFrame, *keys, levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Sort; a key with a level list sorts by its place in that list, unknown levels last."""
    order = []
    for key in keys:
        name, desc = (key[1:], True) if isinstance(key, str) and key.startswith("-") else (key, False)
        if levels and name in levels:
            place = F.nullif(
                F.array_position(F.array(*[F.lit(v) for v in levels[name]]), F.col(name)), F.lit(0)
            )
            order.append(place.desc_nulls_last() if desc else place.asc_nulls_last())
        else:
            order.append(F.col(name).desc() if desc else F.col(name).asc())
    return df.orderBy(*order)


def level_position(col: str, levels: Sequence[str]) -> Column:
    """1-based place of a value in its level list, NULL when it is no level."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col)), F.lit(0))


def keep_params(table: DataFrame, names: Sequence[str], col: str = "parameter") -> DataFrame:
    return table.filter(F.col(col).isin(list(names)))


def top_n(df: DataFrame, n: int, by: Sequence[str], col: str) -> DataFrame:
    """Highest ``n`` rows of each group by ``col``, ties kept.

    Catalyst limits each map task to its own top rows before the shuffle, so a
    large group never travels whole.
    """
    w = Window.partitionBy(*by).orderBy(F.col(col).desc())
    return df.withColumn("_rank", F.rank().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def keep_max(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Rows at their group's maximum, ties kept."""
    best = df.groupBy(*by).agg(F.max(col).alias(col))
    return df.join(best, [*by, col], "left_semi")


def with_order(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "order",
               negative: bool = False) -> DataFrame:
    """Running number in sort order; for result tables such as a top-n report."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(out, -rn if negative else rn)
