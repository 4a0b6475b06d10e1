"""Count tables in long form: (sample_id, feature_id, abundance), zeros left out."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenloom.functions.scalar import RANKS, parse_lineage, strip_suffix
from fenloom.functions.tails import normal_upper
from fenloom.session import cut_lineage, spread


@dataclass(frozen=True)
class CommunityData:
    """Counts, sample sheet, taxonomy and tree that are filtered together."""

    counts: DataFrame
    samples: DataFrame
    taxonomy: DataFrame | None = None
    tree: DataFrame | None = None  # (tip, node, length): each tip with its branches to the root

    def subset(self, samples: DataFrame | None = None, features: DataFrame | None = None) -> "CommunityData":
        """Keep the named samples and features, and what is left in every table."""
        counts, sheet, tax, tree = self.counts, self.samples, self.taxonomy, self.tree
        if samples is not None:
            sheet = sheet.join(samples.select("sample_id"), "sample_id", "left_semi")
        if features is not None:
            counts = counts.join(features.select("feature_id"), "feature_id", "left_semi")
        counts = counts.filter(F.col("abundance") > 0).join(sheet.select("sample_id"), "sample_id", "left_semi")
        if tax is not None:
            counts = counts.join(tax.select("feature_id"), "feature_id", "left_semi")
        present = counts.select("feature_id").distinct()
        sheet = sheet.join(counts.select("sample_id").distinct(), "sample_id", "left_semi")
        if tax is not None:
            tax = tax.join(present, "feature_id", "left_semi")
        if tree is not None:
            tree = prune_tree(tree, present.withColumnRenamed("feature_id", "tip"))
        return replace(self, counts=counts, samples=sheet, taxonomy=tax, tree=tree)


# ---- totals --------------------------------------------------------------------------


def library_size(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample_id").agg(F.sum("abundance").alias("total"))


def feature_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature_id").agg(F.sum("abundance").alias("total"))


def order_features(counts: DataFrame) -> DataFrame:
    return feature_totals(counts).orderBy(F.desc("total"), "feature_id")


def prevalence(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("abundance") > 0).groupBy("feature_id").agg(F.count(F.lit(1)).alias("prevalence"))


def share_of_total(top: DataFrame, everything: DataFrame, value: str) -> DataFrame:
    """Percent of the shown rows' total, and of the grand total."""
    top_sum = top.agg(F.sum(value)).scalar()
    all_sum = everything.agg(F.sum(value)).scalar()
    return top.withColumn("pct_of_top", 100 * F.col(value) / top_sum).withColumn(
        "pct_of_all", 100 * F.col(value) / all_sum)


def tax_summary(taxonomy: DataFrame) -> DataFrame:
    """Distinct names per rank, a missing name counting as one."""
    ranks = taxonomy.select(*parse_lineage("lineage"))
    # (rank, name) pairs are made distinct map side, so no rank is gathered whole
    long = ranks.select(
        F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).alias("name")) for r in RANKS])).alias("p")
    ).select("p.rank", "p.name").distinct()
    return long.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


# ---- filters -------------------------------------------------------------------------


def filter_low_counts(counts: DataFrame, min_count: float = 10) -> DataFrame:
    """Zero every count below the limit; features left without a count vanish."""
    return counts.filter(F.col("abundance") >= min_count)


def clean_features(counts: DataFrame, taxonomy: DataFrame, patterns: Sequence[str],
                   contaminants: DataFrame | None = None, drop_samples: DataFrame | None = None) -> DataFrame:
    """Remove features by taxon text and by list, and control samples."""
    keep = taxonomy
    for p in patterns:
        keep = keep.filter(~F.col("lineage").rlike(p))
    keep = keep.select("feature_id")
    if contaminants is not None:
        keep = keep.join(contaminants.select("feature_id"), "feature_id", "left_anti")
    out = counts.join(keep, "feature_id", "left_semi")
    if drop_samples is not None:
        out = out.join(drop_samples.select("sample_id"), "sample_id", "left_anti")
    return out


def contaminants_prevalence(counts: DataFrame, samples: DataFrame, negative: Column) -> DataFrame:
    """Presence of each feature in controls and true samples, and a one-sided score.

    ``z`` is the continuity-corrected chi-square root of the 2x2 presence table,
    ``score`` its tail: small when the feature is commoner in controls.
    """
    sheet = samples.select("sample_id", negative.cast("int").alias("neg"))
    sizes = sheet.agg(F.struct(F.sum("neg").alias("n_neg"), F.sum(1 - F.col("neg")).alias("n_pos")).alias("s"))
    seen = (
        counts.filter(F.col("abundance") > 0).join(sheet, "sample_id").groupBy("feature_id")
        .agg(F.sum("neg").alias("in_neg"), F.sum(1 - F.col("neg")).alias("in_pos"))
        .withColumn("_s", sizes.scalar())
        .select("feature_id", "in_neg", "in_pos", "_s.n_neg", "_s.n_pos")
    )
    a, b = F.col("in_neg").cast("double"), F.col("in_pos").cast("double")
    c, d = F.col("n_neg") - a, F.col("n_pos") - b
    n = F.col("n_neg") + F.col("n_pos")
    diff = a / F.col("n_neg") - b / F.col("n_pos")
    det = F.abs(a * d - b * c)
    corrected = F.greatest(det - F.least(n / 2, det), F.lit(0.0))
    denom = F.nullif((a + b) * (c + d) * F.col("n_neg") * F.col("n_pos"), F.lit(0.0))
    chi2 = n * corrected * corrected / denom
    z = F.sqrt(chi2) * F.signum(diff)

    return seen.withColumn("z", z).withColumn("score", normal_upper("z"))


# ---- shares, ranks, top-n ------------------------------------------------------------


def to_relative(counts: DataFrame, scale: float = 1.0, by: str = "sample_id") -> DataFrame:
    """Share within each sample: totals are aggregated and joined back, so that one
    very large sample is not gathered for a window."""
    totals = counts.groupBy(by).agg(F.sum("abundance").alias("_t"))
    return counts.join(totals, by).withColumn(
        "abundance", F.lit(float(scale)) * F.col("abundance") / F.nullif("_t", F.lit(0))
    ).drop("_t")


def renorm(counts: DataFrame, units: str = "cpm") -> DataFrame:
    return to_relative(counts, {"cpm": 1e6, "relab": 1.0, "percent": 100.0}[units])


def collapse(counts: DataFrame, taxonomy: DataFrame, rank: str, unknown: str = "Unknown",
             column: str = "sample_id") -> DataFrame:
    """Sum counts to a rank; features without that rank go under ``unknown``."""
    names = dict(zip(RANKS, parse_lineage("lineage")))
    named = taxonomy.select("feature_id", F.coalesce(names[rank], F.lit(unknown)).alias("_g"))
    return (
        counts.join(named, "feature_id")
        .groupBy(column, F.col("_g").alias("feature_id"))
        .agg(F.sum("abundance").alias("abundance"))
    )


def top_n_other(counts: DataFrame, n: int, force_other: Sequence[str] = ("Unknown",), column: str = "sample_id",
                other: str = "other") -> DataFrame:
    """Keep the ``n`` most abundant features and fold the rest into ``other``.

    ``position`` is the stacking order: 0 for "other", then rising shares.
    """
    totals = counts.filter(~F.col("feature_id").isin(list(force_other))).groupBy("feature_id").agg(
        F.sum("abundance").alias("_total"))
    # a plain sort + limit: each task keeps n rows
    top = totals.orderBy(F.desc("_total"), "feature_id").limit(n)
    folded = (
        counts.join(F.broadcast(top.select("feature_id", F.lit(True).alias("_top"))), "feature_id", "left")
        .withColumn("feature_id", F.when(F.col("_top"), F.col("feature_id")).otherwise(F.lit(other)))
        .groupBy(column, "feature_id").agg(F.sum("abundance").alias("abundance"))
    )
    return to_relative(folded, by=column)


def stack_order(shares: DataFrame, other: str = "other") -> DataFrame:
    """Position of each shown feature: "other" first, then by rising total share."""
    per = shares.groupBy("feature_id").agg(F.sum("abundance").alias("_s"))
    is_other = F.col("feature_id") == F.lit(other)
    w = Window.orderBy((~is_other).cast("int"), F.round("_s", 9), "feature_id")  # at most n + 1 rows
    return per.select("feature_id", (F.row_number().over(w) - 1).cast("bigint").alias("position"))


def bar_table(counts: DataFrame, taxonomy: DataFrame, samples: DataFrame, rank: str, by: Sequence[str], n: int,
              sep: str = ".") -> DataFrame:
    """Bar-chart table: counts averaged over the samples of a group (absent = 0), summed to a
    rank, the top ``n`` kept, the rest in "other", as shares of each group."""
    group = F.concat_ws(sep, *[F.col(c) for c in by]).alias("group")
    sheet = samples.select("sample_id", group)
    present = sheet.join(counts.select("sample_id").distinct(), "sample_id", "left_semi")
    sizes = present.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    means = (
        counts.join(sheet, "sample_id").groupBy("group", "feature_id").agg(F.sum("abundance").alias("_sum"))
        .join(sizes, "group")
        .select("group", "feature_id", (F.col("_sum") / F.col("_n")).alias("abundance"))
    )
    # groups x taxa at this rank: small next to the counts, and read three times below
    by_taxon = cut_lineage(collapse(means, taxonomy, rank, column="group"))
    shares = top_n_other(by_taxon, n, column="group")
    return shares.join(F.broadcast(stack_order(shares)), "feature_id")  # n + 1 rows


def top_features(counts: DataFrame, taxonomy: DataFrame, n: int = 20) -> DataFrame:
    top = feature_totals(counts).orderBy(F.desc("total"), "feature_id").limit(n)
    return taxonomy.join(F.broadcast(top), "feature_id").select("feature_id", "total", *parse_lineage("lineage"))


def strip_replicate(counts: DataFrame, pattern: str = r"\.R") -> DataFrame:
    """Drop the replicate suffix of sample names and add up the replicates."""
    return counts.groupBy(strip_suffix("sample_id", pattern).alias("sample_id"), "feature_id").agg(
        F.sum("abundance").alias("abundance"))


# ---- diversity -----------------------------------------------------------------------


def diversity(counts: DataFrame) -> DataFrame:
    """Richness, Shannon entropy and effective species from one aggregate.

    H = ln N - (1/N) sum(x ln x), so no join with the totals is needed.
    """
    x = F.col("abundance").cast("double")
    agg = counts.filter(F.col("abundance") > 0).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("richness"), F.sum(x).alias("_n"), F.sum(x * F.log(x)).alias("_xlx"))
    h = F.log("_n") - F.col("_xlx") / F.col("_n")
    return agg.select("sample_id", "richness", h.alias("shannon"),
                      F.bround(F.round(F.exp(h), 9), 0).alias("effective_species"))


def shannon(counts: DataFrame) -> DataFrame:
    return diversity(counts).select("sample_id", "shannon")


def effective_species(counts: DataFrame) -> DataFrame:
    return diversity(counts).select("sample_id", "effective_species")


def richness(counts: DataFrame) -> DataFrame:
    return diversity(counts).select("sample_id", "richness")


def with_diversity(samples: DataFrame, counts: DataFrame) -> DataFrame:
    return samples.join(diversity(counts), "sample_id")


def rarefy(counts: DataFrame, depth: int, seed: int, chunk: int = 1000) -> DataFrame:
    """Draw ``depth`` individuals per sample without replacement.

    The draw is the first ``depth`` individuals in order of md5(seed|sample|feature|i), so it
    does not depend on partitioning.  It is found without sorting a sample: individuals are
    counted by their first hash digits, which names the digit range the last drawn one falls
    in; ranges before it are taken whole and only that one is sorted.  The number of digits
    follows the deepest sample, so that one range holds some 100,000 individuals at most.  Counts are expanded in chunks spread over the cluster, so one huge count is
    neither one array nor one task.
    """
    whole = counts.filter(F.col("abundance") > 0).withColumn("_n", F.col("abundance").cast("bigint"))
    size = cut_lineage(library_size(whole).filter(F.col("total") >= depth))  # a row per sample
    deepest = size.agg(F.max("total")).first()[0] or 1
    n_digits = max(2, math.ceil(math.log(deepest / 1e5, 16))) if deepest > 1e5 else 1
    deep = size.select("sample_id")
    chunks = (
        whole.join(deep, "sample_id", "left_semi")
        .select("sample_id", "feature_id", "_n", F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / F.lit(chunk)))).alias("_c"))
    )
    chunks = cut_lineage(spread(chunks, "sample_id", "feature_id", "_c"))
    first = F.col("_c") * chunk + 1
    each = chunks.select(
        "sample_id", "feature_id",
        F.explode(F.sequence(first, F.least(first + (chunk - 1), F.col("_n")))).alias("_i"),
    ).select("sample_id", "feature_id",
             F.md5(F.concat_ws("|", F.lit(str(seed)), "sample_id", "feature_id", "_i")).alias("_h"))
    digits = F.substring("_h", 1, n_digits)
    w = Window.partitionBy("sample_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranges = each.groupBy("sample_id", digits.alias("_b")).agg(F.count(F.lit(1)).alias("_k")).withColumn(
        "_cum", F.sum("_k").over(w))
    edge = ranges.filter((F.col("_cum") >= depth) & (F.col("_cum") - F.col("_k") < depth)).select(
        "sample_id", F.col("_b").alias("_edge"), (F.lit(depth) - F.col("_cum") + F.col("_k")).alias("_need"))
    edge = cut_lineage(edge)  # a row per sample
    drawn = cut_lineage(
        each.join(edge, "sample_id").filter(digits <= F.col("_edge"))
        .groupBy("sample_id", "feature_id", "_need", F.when(digits == F.col("_edge"), F.col("_h")).alias("_at"))
        .agg(F.count(F.lit(1)).alias("abundance")))
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("_at"))
    last = drawn.filter(F.col("_at").isNotNull()).withColumn("_r", rank).filter(F.col("_r") <= F.col("_need"))
    return (
        drawn.filter(F.col("_at").isNull()).select("sample_id", "feature_id", "abundance")
        .unionByName(last.select("sample_id", "feature_id", "abundance"))
        .groupBy("sample_id", "feature_id").agg(F.sum("abundance").alias("abundance"))
    )


# ---- trees ---------------------------------------------------------------------------


def tip_closure(edges: DataFrame) -> DataFrame:
    """(tip, node, length): every branch between a tip and the root.

    ``edges`` has (node, parent, branch_length); the root's parent is NULL.  Each round
    doubles the ancestor steps known, so depth 50 takes six rounds.
    """
    nodes = edges.select("node", "parent", "branch_length")
    parents = nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    tips = nodes.join(parents, "node", "left_anti").select(F.col("node").alias("tip"))
    # reach: node -> ancestors found so far; jump: node -> ancestor 2^k steps up
    reach = nodes.select("node", F.col("node").alias("ancestor"))
    jump = nodes.filter(F.col("parent").isNotNull()).select("node", F.col("parent").alias("up"))
    while True:
        further = reach.join(jump.select(F.col("node").alias("ancestor"), "up"), "ancestor").select(
            "node", F.col("up").alias("ancestor"))
        reach = cut_lineage(reach.unionByName(further))
        jump = cut_lineage(
            jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select(
                "node", F.col("up2").alias("up")))
        if jump.isEmpty():
            break
    lengths = nodes.select(F.col("node").alias("ancestor"), F.col("branch_length").alias("length"))
    return (
        reach.join(tips, F.col("node") == F.col("tip"), "left_semi").join(lengths, "ancestor")
        .filter(F.col("length").isNotNull())
        .select(F.col("node").alias("tip"), F.col("ancestor").alias("node"), "length")
    )


def prune_tree(closure: DataFrame, tips: DataFrame) -> DataFrame:
    """Branches leading to the given tips."""
    return closure.join(tips.select("tip"), "tip", "left_semi")


def sample_branches(counts: DataFrame, closure: DataFrame) -> DataFrame:
    """Branches present in each sample, weighted by length, as a count table."""
    present = counts.filter(F.col("abundance") > 0).select("sample_id", F.col("feature_id").alias("tip")).distinct()
    return (
        present.join(closure, "tip").groupBy("sample_id", F.col("node").alias("feature_id"))
        .agg(F.max("length").alias("abundance"))
    )


# ---- sketches as counts ----------------------------------------------------------------


def gather_to_counts(gather: DataFrame) -> DataFrame:
    """Matched k-mers times their mean abundance, as a count table."""
    n = F.col("unique_intersect_bp") / F.col("scaled") * F.col("average_abund")
    return gather.groupBy(F.col("query_name").alias("sample_id"),
                          F.substring_index("name", " ", 1).alias("feature_id")).agg(F.sum(n).alias("abundance"))
