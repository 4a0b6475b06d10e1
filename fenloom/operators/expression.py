"""Differential expression and abundance on long count tables, and the tables built on it."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fenloom.functions.scalar import case_when, first_word, paste, recode, round_even, split_at, strip_suffix
from fenloom.functions.tails import digamma, f_pvalue, t_pvalue, trigamma, trigamma_inverse
from fenloom.operators.community import library_size
from fenloom.operators.ordering import average_rank, exact_quantiles, running_total, suffix_min
from fenloom.session import cut_lineage
from fenloom.operators.tidy import grep_filter, keep_max, mask


# ---- preparation -------------------------------------------------------------------------


def prep_tpm(tpm: DataFrame, min_length: int = 500, suffix: str = r"\.aligned", drop: str = "neg",
             offset: float = 0.1) -> DataFrame:
    """Long transcripts only, rounded half to even, control samples dropped, offset added."""
    return (
        tpm.filter(F.col("length") >= min_length)
        .filter(~F.col("sample_id").rlike(drop))
        .select("feature_id", strip_suffix("sample_id", suffix).alias("sample_id"),
                (round_even("abundance", 0) + F.lit(offset)).alias("abundance"))
    )


# ---- normalisation -------------------------------------------------------------------------


def _upper_quartiles(counts: DataFrame, p: float = 0.75) -> DataFrame:
    """Quantile of count / library size over all features of the table, zeros included."""
    pos = counts.filter(F.col("abundance") > 0)
    n_feat = pos.agg(F.count_distinct("feature_id")).scalar()
    size = library_size(pos)
    cum = running_total(pos.select("sample_id", "abundance", F.lit(1).cast("bigint").alias("_n")),
                        ["sample_id"], "abundance", "_n", "_cum")
    seen = pos.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_seen"))
    j = cum.join(seen, "sample_id").withColumn("_f", n_feat)
    zeros = F.col("_f") - F.col("_seen")
    h = (F.col("_f") - 1) * F.lit(p)
    first, last = zeros + F.col("_cum") - F.col("_n"), zeros + F.col("_cum")
    at = lambda k: F.max(F.when((first <= k) & (k < last), F.col("abundance")))
    q = j.groupBy("sample_id", "_f").agg(at(F.floor(h)).alias("lo"), at(F.ceil(h)).alias("hi"))
    lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(0.0))
    return q.join(size, "sample_id").select(
        "sample_id", "total", ((lo + (h - F.floor(h)) * (hi - lo)) / F.col("total")).alias("q"))


def tmm_factors(counts: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """Trimmed mean of M-values against the sample whose upper quartile is nearest the mean."""
    counts = cut_lineage(counts.select("sample_id", "feature_id", F.col("abundance").cast("double").alias("abundance")))
    quart = cut_lineage(_upper_quartiles(counts))  # a row per sample
    mean_q = quart.agg(F.avg("q")).scalar()
    ref = quart.withColumn("_d", F.round(F.abs(F.col("q") - mean_q), 12)).orderBy("_d", "sample_id").limit(1)
    size = library_size(counts)
    pos = counts.filter(F.col("abundance") > 0).join(size, "sample_id")
    ref_rows = pos.join(F.broadcast(ref.select("sample_id")), "sample_id", "left_semi").select(
        "feature_id", F.col("abundance").alias("yr"), F.col("total").alias("nr"))
    y, n, yr, nr = (F.col(c) for c in ("abundance", "total", "yr", "nr"))
    ma = pos.join(ref_rows, "feature_id").select(
        "sample_id", "feature_id", F.round(F.log2((y / n) / (yr / nr)), 10).alias("m"),
        F.round((F.log2(y / n) + F.log2(yr / nr)) / 2, 10).alias("a"),
        ((n - y) / n / y + (nr - yr) / nr / yr).alias("v"))
    ma = cut_lineage(ma)
    kept = average_rank(average_rank(ma, "m", ["sample_id"], "rm"), "a", ["sample_id"], "ra")
    k = ma.groupBy("sample_id").agg(F.count(F.lit(1)).alias("k"))
    lo_m, lo_a = F.floor(F.col("k") * F.lit(trim_m)) + 1, F.floor(F.col("k") * F.lit(trim_a)) + 1
    keep = (
        (F.col("rm") >= lo_m) & (F.col("rm") <= F.col("k") + 1 - lo_m)
        & (F.col("ra") >= lo_a) & (F.col("ra") <= F.col("k") + 1 - lo_a)
    )
    raw = kept.join(k, "sample_id").filter(keep).groupBy("sample_id").agg(
        (F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("log_f"))
    out = size.join(raw, "sample_id", "left").withColumn("log_f", F.coalesce("log_f", F.lit(0.0)))
    centre = out.agg(F.avg("log_f")).scalar()
    return out.select("sample_id", "total", F.pow(F.lit(2.0), F.col("log_f") - centre).alias("factor"))


def log_cpm(abundance, eff) -> Column:
    """log2 counts per million of the effective library size."""
    return F.log2((F.coalesce(abundance, F.lit(0)).cast("double") + 0.5) / eff * 1e6)


def group_moments(counts: DataFrame, sheet: DataFrame) -> DataFrame:
    """(feature_id, group, n, m, v): mean and variance of log counts per million over all samples of a group.

    ``sheet`` has (sample_id, group, eff). A count of zero gives a value that depends on its sample
    alone, so the sums over a whole group of zeros are known once, and only the counts that are
    there are shuffled, as differences from them. Values are centred on the group's zeros.
    """
    zero = log_cpm(F.lit(None), F.col("eff"))
    groups = sheet.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg(zero).alias("centre"))
    sheet = cut_lineage(sheet.join(groups, "group").withColumn("dz", zero - F.col("centre")))
    levels = sheet.groupBy("group", "n", "centre").agg(F.sum(F.col("dz") * F.col("dz")).alias("zz")).agg(
        F.collect_list(F.struct("group", "n", "centre", "zz"))).scalar()  # a row per level of the factor
    d = log_cpm(F.col("abundance"), F.col("eff")) - F.col("centre")
    # features of other samples alone come through with a null group
    seen = counts.join(sheet.select("sample_id", "group", "eff", "centre", "dz"), "sample_id", "left").groupBy("feature_id", "group").agg(
        F.sum(d - F.col("dz")).alias("s"), F.sum(d * d - F.col("dz") * F.col("dz")).alias("ss"))
    seen = cut_lineage(seen)
    every = seen.select("feature_id").distinct().select("feature_id", F.inline(levels))
    s, n = F.coalesce("s", F.lit(0.0)), F.col("n")
    left = F.greatest(F.col("zz") + F.coalesce("ss", F.lit(0.0)) - s * s / n, F.lit(0.0))
    return every.join(seen, ["feature_id", "group"], "left").select(
        "feature_id", "group", "n", (F.col("centre") + s / n).alias("m"), F.when(n > 1, left / (n - 1)).alias("v"))


def voom(counts: DataFrame, factors: DataFrame, samples: DataFrame, factor: str, bins: int = 20) -> DataFrame:
    """log-CPM with precision weights, a row for every feature in every sample that has a level.

    The trend of sqrt(residual sd) on mean log count is taken as means over equal-sized
    bins of features, joined by straight lines and flat beyond the ends; a weight is the
    trend at the fitted log count to the power -4.
    """
    factors = cut_lineage(factors)  # a row per sample
    sheet = cut_lineage(factors.select("sample_id", (F.col("total") * F.col("factor") + 1).alias("eff")).join(
        samples.select("sample_id", F.col(factor).alias("group")), "sample_id").filter("group IS NOT NULL"))
    counts = counts.select("sample_id", "feature_id", "abundance")
    fit = cut_lineage(group_moments(counts, sheet))
    per = fit.groupBy("feature_id").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        F.sqrt(F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))) / (F.sum("n") - F.count("group"))).alias("sd"))
    shift = factors.agg(F.avg(F.log2(F.col("total") * F.col("factor") + 1)) - F.lit(math.log2(1e6))).scalar()
    pts = cut_lineage(per.select(F.round(F.col("mean") + shift, 9).alias("sx"), F.sqrt("sd").alias("sy")))
    total = pts.agg(F.count(F.lit(1))).scalar()
    cum = running_total(pts.select("sx", F.lit(1).cast("bigint").alias("_n")), [], "sx", "_n", "_cum")
    ranked = pts.join(cum, "sx")
    binned = ranked.withColumn(
        "bin", F.floor((F.col("_cum") - F.col("_n")) * F.lit(bins) / total))
    knots = (
        binned.groupBy("bin").agg(F.avg("sx").alias("x"), F.avg("sy").alias("y")).orderBy("bin").collect()
    )  # at most `bins` rows
    xs, ys = [float(r["x"]) for r in knots], [float(r["y"]) for r in knots]
    at = F.col("m") + F.log2("eff") - F.lit(math.log2(1e6))
    trend = F.when(at <= xs[0], F.lit(ys[0]))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        if x1 > x0:
            trend = trend.when(at <= x1, F.lit(y0) + (at - x0) * F.lit((y1 - y0) / (x1 - x0)))
    trend = trend.otherwise(F.lit(ys[-1]))
    cells = fit.select("feature_id", "group", "m").join(sheet, "group").join(counts, ["feature_id", "sample_id"], "left")
    return cells.select("feature_id", "sample_id", "group", log_cpm(F.col("abundance"), F.col("eff")).alias("e"),
                        F.pow(trend, F.lit(-4.0)).alias("weight"))


# ---- contrasts and moderated t ------------------------------------------------------------


def one_against_rest(levels: Sequence[str]) -> dict[str, dict[str, float]]:
    """Each level against the mean of the others."""
    rest = -1.0 / (len(levels) - 1)
    return {f"Test{a}": {b: (1.0 if a == b else rest) for b in levels} for a in levels}


def contrasts(values: DataFrame, coefs: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Weighted group means per feature and, per contrast, its estimate and unscaled error.

    ``values`` has (feature_id, group, e, weight).
    """
    w, e = F.col("weight"), F.col("e")
    grp = values.groupBy("feature_id", "group").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * e).alias("swe"), F.sum(w * e * e).alias("swee"),
        F.sum(e).alias("se"))
    levels = sorted({g for c in coefs.values() for g in c})
    per = grp.groupBy("feature_id").agg(
        (F.sum("se") / F.sum("n")).alias("ave_expr"),
        (F.sum("n") - F.count("group")).alias("df"),
        F.sum(F.greatest(F.col("swee") - F.col("swe") * F.col("swe") / F.col("sw"), F.lit(0.0))).alias("rss"),
        *[F.max(F.when(F.col("group") == g, F.col("swe") / F.col("sw"))).alias(f"m_{i}") for i, g in enumerate(levels)],
        *[F.max(F.when(F.col("group") == g, 1 / F.col("sw"))).alias(f"u_{i}") for i, g in enumerate(levels)])
    rows = []
    for name, c in coefs.items():
        est = sum((F.lit(c[g]) * F.col(f"m_{i}") for i, g in enumerate(levels) if c.get(g)), F.lit(0.0))
        var = sum((F.lit(c[g] ** 2) * F.col(f"u_{i}") for i, g in enumerate(levels) if c.get(g)), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("contrast"), est.alias("log_fc"), F.sqrt(var).alias("unscaled")))
    return per.select(
        "feature_id", "ave_expr", "df", (F.col("rss") / F.col("df")).alias("s2"), F.explode(F.array(*rows)).alias("r")
    ).select("feature_id", "r.contrast", "r.log_fc", "ave_expr", "r.unscaled", "s2", "df")


def ebayes(fit: DataFrame) -> DataFrame:
    """Moderated t: residual variances are drawn towards a common prior.

    The prior comes from the mean and variance of ln s^2 over features: two aggregates on
    the cluster and one scalar equation on the driver.
    """
    fit = cut_lineage(fit)
    one = fit.select("feature_id", "s2", "df").distinct().filter(F.col("s2") > 0)
    s = one.agg(F.avg(F.log("s2")).alias("m"), F.var_samp(F.log("s2")).alias("v"), F.max("df").alias("df"),
                F.count(F.lit(1)).alias("n")).first()
    half = float(s["df"]) / 2
    mean_e = s["m"] - digamma(half) + math.log(half)
    spread = (s["v"] or 0.0) - trigamma(half)
    if spread > 0:
        d0 = 2 * trigamma_inverse(spread)
        s02 = math.exp(mean_e + digamma(d0 / 2) - math.log(d0 / 2))
        post = (F.lit(d0 * s02) + F.col("df") * F.col("s2")) / (F.lit(d0) + F.col("df"))
    else:
        d0, s02 = math.inf, math.exp(mean_e)
        post = F.lit(s02)
    df_total = F.least(F.lit(d0) + F.col("df"), F.lit(float(s["df"]) * s["n"]))
    t = F.col("log_fc") / (F.sqrt("s2_post") * F.col("unscaled"))
    return (
        fit.withColumn("s2_post", post).withColumn("t", t).withColumn("df_total", df_total)
        .withColumn("p", t_pvalue("t", "df_total"))
    )


def bh_adjust(df: DataFrame, p: str = "p", by: Sequence[str] = (), out: str = "padj",
              ranges: int | None = None) -> DataFrame:
    """Benjamini-Hochberg: p m / rank, made monotone from the largest p, at most 1.

    Equal p-values share a row while ranking, so the sort is over distinct values.
    """
    by = list(by)
    df = cut_lineage(df)
    ok = df.filter(F.col(p).isNotNull())
    cum = running_total(ok.select(*by, p, F.lit(1).cast("bigint").alias("_n")), by, p, "_n", "_cum", ranges=ranges)
    m = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    ratio = (cum.join(m, by) if by else cum.withColumn("_m", m.scalar())).select(
        *by, p, (F.col(p) * F.col("_m") / F.col("_cum")).alias("_q"))
    adj = suffix_min(ratio, by, p, "_q", "_adj", ranges).select(*by, p, F.least("_adj", F.lit(1.0)).alias(out))
    return df.join(adj, [*by, p], "left")


def call_status(log_fc="log_fc", padj="padj", alpha: float = 0.05) -> Column:
    f, q = F.col(log_fc), F.col(padj)
    return case_when((( f > 0) & (q < alpha), "up"), ((f < 0) & (q < alpha), "down"), otherwise="not.signif")


def top_table(fit: DataFrame, contrast: str) -> DataFrame:
    out = bh_adjust(fit.filter(F.col("contrast") == contrast))
    return out.orderBy("p", "feature_id")


def ma_table(table: DataFrame, annotation: DataFrame, cols: Sequence[str], lfc: float = 6.0,
             expr: float = 6.0) -> DataFrame:
    """Status, and the annotation shown only for significant outliers."""
    status = call_status()
    far = (F.abs("log_fc") >= lfc) | (F.col("ave_expr") > expr)
    named = table.withColumn("status", status).withColumn(
        "delabel", F.when(F.col("status") != "not.signif", F.col("feature_id"))
    ).withColumn("outlier", F.when(far & (F.col("status") != "not.signif"), F.col("feature_id")))
    return mask(named.join(annotation, "feature_id", "left"), F.col("outlier").isNull(), cols)


def significant_union(tables: DataFrame, alpha: float = 0.05, min_lfc: float = 0.0) -> DataFrame:
    """Features significant in any contrast beyond a fold-change limit."""
    return tables.filter((F.col("padj") < alpha) & (F.abs("log_fc") > min_lfc)).select("feature_id").distinct()


def deg_expression(tables: DataFrame, expression: DataFrame, annotation: DataFrame, alpha: float = 0.05,
                   min_lfc: float = 4.0) -> DataFrame:
    """Expression of the significant features with their function."""
    keys = significant_union(tables, alpha, min_lfc)
    return expression.join(keys, "feature_id", "left_semi").join(annotation, "feature_id", "left")


# ---- bias-corrected log-linear differential abundance ---------------------------------------


def log_linear_bc(counts: DataFrame, samples: DataFrame, factor: str, levels: Sequence[str], prv_cut: float = 0.3,
                  pseudo: float = 1.0) -> DataFrame:
    """Per feature and level pair: bias-corrected difference of mean log counts.

    Features below the prevalence cut are left out.  Differences share a per-pair bias from
    unequal sampling depth, estimated as the median over features and subtracted.  With a
    pseudo-count of 1 an absent feature adds 0 to every sum, so zeros are never expanded.
    """
    base = math.log(pseudo)
    sheet = samples.filter(F.col(factor).isin(list(levels))).select("sample_id", F.col(factor).alias("group"))
    size = sheet.groupBy().agg(
        F.struct(*[F.count(F.when(F.col("group") == g, 1)).alias(f"n_{i}") for i, g in enumerate(levels)])).scalar()
    x = F.log(F.col("abundance") + F.lit(pseudo)) - F.lit(base)
    pos = counts.filter(F.col("abundance") > 0).join(sheet, "sample_id").withColumn("x", x)
    aggs = [F.count(F.lit(1)).alias("seen")]
    for i, g in enumerate(levels):
        here = F.when(F.col("group") == g, F.col("x"))
        aggs += [F.coalesce(F.sum(here), F.lit(0.0)).alias(f"s_{i}"),
                 F.coalesce(F.sum(here * here), F.lit(0.0)).alias(f"q_{i}")]
    per = pos.groupBy("feature_id").agg(*aggs).withColumn("size", size)
    n = [F.col(f"size.n_{i}") for i in range(len(levels))]
    total = sum(n[1:], n[0])
    per = per.filter(F.col("seen") / total >= prv_cut)
    ss = sum((F.col(f"q_{i}") - F.col(f"s_{i}") * F.col(f"s_{i}") / n[i] for i in range(len(levels))), F.lit(0.0))
    s2 = F.greatest(ss, F.lit(0.0)) / (total - len(levels))
    rows = [
        F.struct(F.lit(f"{levels[b]}_vs_{levels[a]}").alias("contrast"),
                 (F.col(f"s_{b}") / n[b] - F.col(f"s_{a}") / n[a]).alias("raw"),
                 F.sqrt(s2 * (1 / n[a] + 1 / n[b])).alias("se"),
                 F.try_divide(n[a] * n[b] / total, s2).alias("precision"))
        for a in range(len(levels)) for b in range(a + 1, len(levels))]
    per = cut_lineage(per)
    long = per.select("feature_id", (total - len(levels)).alias("df"), F.explode(F.array(*rows)).alias("r")).select(
        "feature_id", "df", "r.*")
    bias = exact_quantiles(long, ["contrast"], "raw", {"bias": 0.5}).select("contrast", "bias")
    return long.join(bias, "contrast").select(
        "feature_id", "contrast", (F.col("raw") - F.col("bias")).alias("lfc"), "se", "bias",
        F.try_divide(F.col("raw") - F.col("bias"), F.col("se")).alias("w"), "df", "precision")


def diff_abundance(counts: DataFrame, samples: DataFrame, factor: str, levels: Sequence[str], prv_cut: float = 0.3,
                   alpha: float = 0.05) -> DataFrame:
    fit = log_linear_bc(counts, samples, factor, levels, prv_cut)
    tested = fit.withColumn("p", t_pvalue("w", F.col("df").cast("double")))
    return bh_adjust(tested, "p", ["contrast"], "q").withColumn("diff", F.col("q") < alpha)


def global_test(fit: DataFrame, k: int) -> DataFrame:
    """Any difference among ``k`` groups: the one-way F ratio of the corrected means.

    The sum of squares between groups is the sum over pairs of n_a n_b / N times their squared
    difference, whatever the sizes; ``precision`` holds that factor over the residual variance."""
    per = fit.groupBy("feature_id").agg(
        (F.sum(F.col("precision") * F.col("lfc") * F.col("lfc")) / (k - 1)).alias("f"), F.max("df").alias("df"))
    return per.withColumn("p", f_pvalue("f", F.lit(float(k - 1)), F.col("df").cast("double")))


def any_diff(results: DataFrame, flag: str = "diff") -> DataFrame:
    hits = results.groupBy("feature_id").agg(F.bool_or(flag).alias("any"))
    return hits.filter("any").select("feature_id")


def diff_table(features: DataFrame, taxonomy: DataFrame, counts: DataFrame, samples: DataFrame,
               keep_times: Sequence, time: str, drop_controls: Column) -> DataFrame:
    """Counts of the significant features at the given times without control samples."""
    sheet = samples.filter(F.col(time).isin(list(keep_times)) & ~drop_controls).select("sample_id", time)
    return (
        counts.join(features.select("feature_id"), "feature_id", "left_semi").join(sheet, "sample_id")
        .join(taxonomy, "feature_id")
    )


# ---- function tables ------------------------------------------------------------------------


def heat_table(expression: DataFrame, label: str, drop: str, column: str = "sample_id", half: float = 0.5) -> DataFrame:
    """log2(sum + 1/2) by function and sample, with the function's row total for ordering.

    Rows without a function are left out; samples matching ``drop`` go after the totals.
    """
    cells = expression.filter(F.col(label).isNotNull()).groupBy(label, column).agg(
        F.log2(F.sum("abundance") + F.lit(half)).alias("log2"))
    total = cells.groupBy(label).agg(F.sum("log2").alias("row_total"))
    return cells.join(total, label).filter(~F.col(column).rlike(drop))


def function_table(expression: DataFrame, label: str, pattern: str, drop_week: str, half: float = 0.5) -> DataFrame:
    hit = grep_filter(expression, label, pattern, ignore_case=True)
    return hit.filter(F.col("week") != drop_week).withColumn("log2_tpm", F.log2(F.col("abundance") + F.lit(half)))


def decode_sample(df: DataFrame, col: str, treatments: Mapping[str, str], days: Mapping[str, int],
                  sep: str = "_") -> DataFrame:
    """sample_plant_treatment_week names to columns, with code labels and days."""
    part = F.split(F.col(col), sep)
    return df.withColumn("sample", F.get(part, F.lit(0))).withColumn("plant", F.get(part, F.lit(1))).withColumn(
        "treatment", recode(F.get(part, F.lit(2)), treatments)
    ).withColumn("week", F.get(part, F.lit(3))).withColumn("day", recode(F.get(part, F.lit(3)), days))


def best_hits(hits: DataFrame, max_evalue: float = 1e-3, min_score: float = 99) -> DataFrame:
    """Significant hits, gene name from the first two fields, best score per gene (ties kept)."""
    head, _ = split_at("query", "_", 2)
    ok = hits.filter((F.col("evalue") < max_evalue) & (F.col("score") > min_score)).withColumn("gene_name", head)
    return keep_max(ok.drop("query"), ["gene_name"], "score")


def annotate_ko(hits: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Attach the pathway levels by the first word of the leaf; drop hits without a pathway."""
    levels = hierarchy.withColumn("KO", first_word("L4"))
    return hits.join(levels, "KO", "left").dropna(subset=["L1"])


def mag_functions(hits: DataFrame, functions: DataFrame, taxonomy: DataFrame, pattern: str,
                  classes: Sequence[tuple[str, str]]) -> DataFrame:
    """Hits to genomes with their function and species, keyword class, and counts at two grains."""
    from fenloom.operators.summary import add_count

    contig, bin_ = split_at("contig_bin", "_", 2)
    named = hits.withColumn("contig", contig).withColumn("bin", bin_)
    fun = named.join(functions, "gene_name", "left").dropna(subset=["KO"])
    fun = grep_filter(fun, "KO_definition", pattern, ignore_case=True)
    out = fun.join(taxonomy, "bin").withColumn("mag_species", paste("new_bin", "species", sep="-")).withColumn(
        "broad_class", case_when(*[(F.col("KO_definition").rlike(p), v) for p, v in classes]))
    out = add_count(out, ["mag_species", "KO_definition"], "value")
    # NULL classes form a group of their own, which an equi-join would drop
    per = out.groupBy("mag_species", "broad_class").agg(F.count(F.lit(1)).alias("value_class"))
    per = per.select(F.col("mag_species").alias("_s"), F.col("broad_class").alias("_b"), "value_class")
    return out.join(per, (F.col("mag_species") == F.col("_s")) & F.col("broad_class").eqNullSafe(F.col("_b"))).drop(
        "_s", "_b")
