"""Factor models, analysis of variance, and resampled intervals.

Closed forms are used where they exist: a model on one factor is a set of group moments.
The Bayesian bootstrap (Rubin 1981) stands in for posterior sampling and is named so.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from fenloom.functions.scalar import hash32
from fenloom.functions.tails import f_pvalue, range_pvalue
from fenloom.operators.permutation import EPS, MAX_CELLS, _design
from fenloom.session import cut_lineage, spread


def fit_factor(df: DataFrame, y: str, factor: str, ref, family: str = "gaussian") -> DataFrame:
    """Coefficients (difference to the reference level) with standard errors.

    ``gaussian``: group means and the pooled variance.  ``gamma``: log link, for which the
    group log-means are the exact maximum-likelihood fit; dispersion by Pearson residuals.
    """
    grp = df.filter(F.col(y).isNotNull()).groupBy(F.col(factor).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
    if family == "gamma":
        est, scatter = F.log("m"), (F.col("n") - 1) * F.coalesce("v", F.lit(0.0)) / (F.col("m") * F.col("m"))
    else:
        est, scatter = F.col("m"), (F.col("n") - 1) * F.coalesce("v", F.lit(0.0))
    # one row per level from here on
    every = Window.partitionBy()
    s2 = F.sum(scatter).over(every) / (F.sum("n").over(every) - F.count("level").over(every))
    is_ref = F.col("level") == F.lit(ref)
    base = F.max(F.when(is_ref, est)).over(every)
    base_n = F.max(F.when(is_ref, F.col("n"))).over(every)
    out = grp.select("level", "n", est.alias("est"), s2.alias("s2"), base.alias("base"), base_n.alias("base_n"))
    is_ref = F.col("level") == F.lit(ref)
    return out.select(
        F.when(is_ref, F.lit("Intercept")).otherwise(F.col("level").cast("string")).alias("parameter"),
        F.when(is_ref, F.col("est")).otherwise(F.col("est") - F.col("base")).alias("estimate"),
        F.sqrt(F.when(is_ref, F.col("s2") / F.col("n"))
               .otherwise(F.col("s2") / F.col("n") + F.col("s2") / F.col("base_n"))).alias("se"),
        F.sqrt("s2").alias("sigma"),
    )


def fit_glm(df: DataFrame, formula: str, family: str, link: str, weights: str | None = None) -> DataFrame:
    """Generalised linear model: one row per coefficient with its standard error."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    prep = RFormula(formula=formula, featuresCol="_x", labelCol="_y", stringIndexerOrderType="alphabetAsc").fit(df)
    data = prep.transform(df)
    glm = GeneralizedLinearRegression(family=family, link=link, featuresCol="_x", labelCol="_y", maxIter=50, tol=1e-10)
    if weights:
        glm = glm.setWeightCol(weights)
    model = glm.fit(data)
    attrs = data.schema["_x"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for g in attrs.values() for a in g), key=lambda a: a["idx"])]
    est = [float(v) for v in model.coefficients] + [float(model.intercept)]
    try:
        se = [float(v) for v in model.summary.coefficientStandardErrors]
    except Exception as e:
        if "No Std. Error" not in str(e):  # what the solver says of a rank-deficient design
            raise
        se = [None] * len(est)
    return df.sparkSession.createDataFrame(
        list(zip([*names, "Intercept"], est, se)), "parameter string, estimate double, se double")


def interaction_columns(df: DataFrame, y: str, a: str, b: str) -> tuple[DataFrame, str]:
    """Indicator columns for ``a * b`` with the first level of each as reference, and
    the formula that uses them.  The number of levels is checked."""
    cells = df.select(a, b).distinct().limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    la, lb = (sorted({r[c] for r in cells})[1:] for c in (a, b))
    seen = {(r[a], r[b]) for r in cells}
    cols = {f"a{i}": (F.col(a) == F.lit(v)) for i, v in enumerate(la)}
    cols |= {f"b{j}": (F.col(b) == F.lit(v)) for j, v in enumerate(lb)}
    cols |= {f"a{i}b{j}": (F.col(a) == F.lit(u)) & (F.col(b) == F.lit(v))
             for i, u in enumerate(la) for j, v in enumerate(lb) if (u, v) in seen}
    out = df.select(y, *[c.cast("double").alias(k) for k, c in cols.items()])
    return out, f"{y} ~ " + " + ".join(cols)


def variance_components(df: DataFrame, y: str, fixed: str, group: str) -> DataFrame:
    """Within and between variance of a random intercept, by the method of moments.

    The fixed factor's means are taken out first; then the one-way random-effects sums.
    """
    ok = df.filter(F.col(y).isNotNull())
    means = ok.groupBy(fixed).agg(F.avg(y).alias("_m"))
    resid = ok.join(means, fixed).withColumn("_e", F.col(y) - F.col("_m"))
    grp = resid.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("m"), F.var_samp("_e").alias("v"))
    n = F.col("n").cast("double")
    sums = grp.agg(
        F.count(F.lit(1)).alias("g"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"),
        F.sum(n * F.col("m") * F.col("m")).alias("a"), F.sum(n * F.col("m")).alias("b"),
        F.sum((n - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"))
    msb = (F.col("a") - F.col("b") * F.col("b") / F.col("n")) / (F.col("g") - 1)
    msw = F.col("ssw") / (F.col("n") - F.col("g"))
    n0 = (F.col("n") - F.col("n2") / F.col("n")) / (F.col("g") - 1)
    return sums.select(F.col("g").alias("groups"), msw.alias("var_within"),
                       F.greatest((msb - msw) / n0, F.lit(0.0)).alias("var_between"))


# ---- analysis of variance ------------------------------------------------------------------


def anova_oneway(df: DataFrame, y: str, factor: str) -> DataFrame:
    grp = df.filter(F.col(y).isNotNull()).groupBy(factor).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
    n = F.col("n").cast("double")
    s = grp.agg(
        F.count(F.lit(1)).alias("a"), F.sum(n).alias("N"), F.sum(n * F.col("m")).alias("s1"),
        F.sum(n * F.col("m") * F.col("m")).alias("s2"), F.sum((n - 1) * F.coalesce("v", F.lit(0.0))).alias("ss_within"))
    s = s.withColumn("ss_between", F.col("s2") - F.col("s1") * F.col("s1") / F.col("N"))
    d1, d2 = F.col("a") - 1, F.col("N") - F.col("a")
    f = (F.col("ss_between") / d1) / (F.col("ss_within") / d2)
    s = s.select(d1.cast("bigint").alias("df1"), d2.cast("bigint").alias("df2"), "ss_between", "ss_within", f.alias("f"))
    return s.withColumn("p", f_pvalue("f", F.col("df1").cast("double"), F.col("df2").cast("double")))


def anova(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Sequential analysis of variance with the interaction of all factors last.

    The data is reduced to cell moments on the cluster; the small least-squares solves over
    cells are done on the driver.
    """
    factors = list(factors)
    cells = (
        df.filter(F.col(y).isNotNull()).groupBy(*factors)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
        .orderBy(*factors).limit(MAX_CELLS + 1).collect()
    )
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    terms = [(f,) for f in factors] + ([tuple(factors)] if len(factors) > 1 else [])
    n = np.array([c["n"] for c in cells], float)
    m = np.array([c["m"] for c in cells])
    within = float(sum((c["n"] - 1) * (c["v"] or 0.0) for c in cells))
    blocks = _design(cells, terms)
    rss, ranks = [], []
    centre = float((n * m).sum() / n.sum())
    for k in range(len(blocks)):
        x = np.hstack(blocks[: k + 1])
        root = np.sqrt(n)
        beta, *_ = np.linalg.lstsq(x * root[:, None], (m - centre) * root, rcond=1e-12)
        rss.append(float((n * (m - centre - x @ beta) ** 2).sum()) + within)
        ranks.append(int(np.linalg.matrix_rank(x)))
    df_res = int(n.sum()) - ranks[-1]
    rows = []
    for t, term in enumerate(terms, start=1):
        ss, d = rss[t - 1] - rss[t], ranks[t] - ranks[t - 1]
        f = (ss / d) / (rss[-1] / df_res) if d else None
        rows.append((":".join(term), d, ss, f))
    rows.append(("Residual", df_res, rss[-1], None))
    out = df.sparkSession.createDataFrame(rows, "term string, df bigint, ss double, f double")
    return out.withColumn("p", f_pvalue("f", F.col("df").cast("double"), F.lit(float(df_res))))


def pairwise_means(df: DataFrame, y: str, factor: str, id_col: str, nperm: int = 199, seed: int = 1) -> DataFrame:
    """All level pairs: difference, q statistic, and p from the permuted largest q.

    Permutations come from md5(seed|perm|id); each is a shuffle of the labels over the rows.
    """
    from fenloom.operators.permutation import _coded, permuted_labels

    rows = df.filter(F.col(y).isNotNull()).select(F.col(id_col).alias("sample_id"), F.col(y).alias("y"), factor)
    coded, cells = _coded(rows, [factor])
    names = [str(c[factor]) for c in cells]
    a = len(cells)
    labels = permuted_labels(coded, nperm, seed)
    moments = (
        rows.select("sample_id", "y").join(labels, "sample_id")
        .select("y", F.posexplode("codes").alias("perm", "code"))
        .groupBy("perm", "code").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    )
    # one row per permutation, holding its few group moments
    per = moments.groupBy("perm").agg(
        F.sort_array(F.collect_list(F.struct("code", "n", "m"))).alias("g"),
        (F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))) / (F.sum("n") - a)).alias("s2"))
    pairs = [(x, z) for x in range(a) for z in range(x + 1, a)]

    def q(x: int, z: int) -> Column:
        gx, gz = F.col("g")[x], F.col("g")[z]
        return F.abs(gz["m"] - gx["m"]) / F.sqrt(F.col("s2") / 2 * (1 / gx["n"] + 1 / gz["n"]))

    largest = F.greatest(*[q(x, z) for x, z in pairs]) if len(pairs) > 1 else q(*pairs[0])
    out = per.withColumn("q_max", largest)
    perm_q = out.filter("perm > 0").agg(F.collect_list("q_max")).scalar()  # nperm numbers
    arr = F.array(*[
        F.struct(F.lit(names[x]).alias("level_a"), F.lit(names[z]).alias("level_b"),
                 (F.col("g")[z]["m"] - F.col("g")[x]["m"]).alias("diff"), q(x, z).alias("q"))
        for x, z in pairs])
    obs = out.filter("perm = 0").select(F.explode(arr).alias("r")).select("r.*").withColumn("_q", perm_q)
    hits = F.size(F.filter("_q", lambda v: v >= F.col("q") * F.lit(1 - EPS)))
    return obs.select("level_a", "level_b", "diff", "q", ((1 + hits) / F.lit(1.0 + nperm)).alias("p"))


# ---- Bayesian bootstrap -----------------------------------------------------------------------


def bootstrap_weight(seed: int, draw, row_id) -> Column:
    """Exp(1) weight of a row in a draw, from its hash."""
    h = hash32(F.lit(str(seed)), draw, row_id)
    return -F.log((h + F.lit(0.5)) / F.lit(4294967296.0))


def _drawn(df: DataFrame, row_id: str, n_draws: int, seed: int) -> DataFrame:
    # every row is expanded n_draws times: spread the narrow rows first
    return spread(df, row_id).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws)))).withColumn(
        "_w", bootstrap_weight(seed, F.col("draw"), F.col(row_id)))


def level_draws(df: DataFrame, y: str, factor: str, row_id: str, n_draws: int, seed: int) -> DataFrame:
    """(draw, level, mean): weighted group means per draw.

    Rows are expanded by draws where they lie; only draw x level sums are shuffled.
    """
    rows = df.filter(F.col(y).isNotNull()).select(F.col(row_id), F.col(factor).alias("level"), F.col(y).alias("_y"))
    return _drawn(rows, row_id, n_draws, seed).groupBy("draw", "level").agg(
        (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("mean"))


def draws(df: DataFrame, y: str, factor: str, ref, levels: Sequence, row_id: str, n_draws: int = 200, seed: int = 1,
          family: str = "gaussian") -> DataFrame:
    """(draw, parameter, value): intercept and differences to the reference per draw."""
    means = level_draws(df, y, factor, row_id, n_draws, seed)
    link = F.log("mean") if family == "gamma" else F.col("mean")
    base = means.filter(F.col("level") == F.lit(ref)).select("draw", link.alias("_base"))
    out = means.filter(F.col("level").isin(list(levels))).join(base, "draw")
    is_ref = F.col("level") == F.lit(ref)
    return out.select(
        "draw", F.when(is_ref, F.lit("Intercept")).otherwise(F.col("level").cast("string")).alias("parameter"),
        F.when(is_ref, link).otherwise(link - F.col("_base")).alias("value"))


def intervals(draw_table: DataFrame, prob: float = 0.5, outer: float = 0.95) -> DataFrame:
    """ll, l, m, h, hh per parameter; each group holds one value per draw."""
    a, b = (1 - outer) / 2, (1 - prob) / 2
    probs = [a, b, 0.5, 1 - b, 1 - a]
    q = F.percentile("value", F.array(*[F.lit(p) for p in probs]))
    out = draw_table.groupBy("parameter").agg(q.alias("q"))
    return out.select("parameter", *[F.col("q")[i].alias(n) for i, n in enumerate(("ll", "l", "m", "h", "hh"))])


def flag_nonzero(table: DataFrame) -> DataFrame:
    away = ((F.col("ll") > 0) & (F.col("hh") > 0)) | ((F.col("ll") < 0) & (F.col("hh") < 0))
    return table.withColumn("nonzero", F.when(away, "nonzero").otherwise("zero"))


def posterior_interval(draw_table: DataFrame, prob: float = 0.9) -> DataFrame:
    a = (1 - prob) / 2
    q = F.percentile("value", F.array(F.lit(a), F.lit(1 - a)))
    return draw_table.groupBy("parameter").agg(q.alias("q")).select(
        "parameter", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def marginal_levels(df: DataFrame, y: str, factor: str, row_id: str, n_draws: int, seed: int) -> DataFrame:
    """Predicted response per level with a 95 % interval."""
    means = level_draws(df, y, factor, row_id, n_draws, seed)
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return means.groupBy("level").agg(q.alias("q")).select(
        "level", F.col("q")[1].alias("predicted"), F.col("q")[0].alias("conf_low"), F.col("q")[2].alias("conf_high"))


def line_draws(df: DataFrame, y: str, x: str, row_id: str, n_draws: int, seed: int, log_link: bool = False) -> DataFrame:
    """(draw, intercept, slope) of a weighted straight line per draw."""
    rows = df.dropna(subset=[y, x]).select(
        F.col(row_id), F.col(x).cast("double").alias("_x"), (F.log(y) if log_link else F.col(y)).alias("_y"))
    w, xx, yy = F.col("_w"), F.col("_x"), F.col("_y")
    s = _drawn(rows, row_id, n_draws, seed).groupBy("draw").agg(
        F.sum(w).alias("sw"), F.sum(w * xx).alias("sx"), F.sum(w * yy).alias("sy"),
        F.sum(w * xx * xx).alias("sxx"), F.sum(w * xx * yy).alias("sxy"))
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")) / (
        F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw"))
    return s.withColumn("slope", slope).select(
        "draw", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("intercept"), "slope")


def marginal_grid(lines: DataFrame, grid: Sequence[float], log_link: bool = False) -> DataFrame:
    """Prediction along a covariate grid with a 95 % interval."""
    at = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x")
    pred = F.col("intercept") + F.col("slope") * F.col("x")
    q = F.percentile("p", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = lines.select("intercept", "slope", at).select("x", (F.exp(pred) if log_link else pred).alias("p"))
    return out.groupBy("x").agg(q.alias("q")).select(
        "x", F.col("q")[1].alias("predicted"), F.col("q")[0].alias("conf_low"), F.col("q")[2].alias("conf_high"))


def pp_check(df: DataFrame, y: str, factor: str, row_id: str, n_draws: int, seed: int) -> DataFrame:
    """Replicated against observed mean, sd, min and max; draw 0 is the data.

    A replicate is the draw's level mean plus the residual spread times a normal number
    made from two hashes.
    """
    rows = df.filter(F.col(y).isNotNull()).select(F.col(row_id), F.col(factor).alias("level"), F.col(y).alias("_y"))
    means = level_draws(rows, "_y", "level", row_id, n_draws, seed)
    grp = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.var_samp("_y").alias("v"))
    sigma = grp.agg(F.sqrt(F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))) / (F.sum("n") - F.count("level")))
                    ).scalar()
    unit = lambda tag: (hash32(F.lit(f"{seed}{tag}"), F.col("draw"), F.col(row_id)) + F.lit(0.5)) / F.lit(4294967296.0)  # noqa: E731,E501
    noise = F.sqrt(-2 * F.log(unit("u"))) * F.cos(F.lit(2 * math.pi) * unit("v"))
    rep = (
        spread(rows, row_id).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws)))).join(means, ["draw", "level"])
        .select("draw", (F.col("mean") + sigma * noise).alias("_y"))
    )
    both = rows.select(F.lit(0).alias("draw"), "_y").unionByName(rep)
    return both.groupBy("draw").agg(
        F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("sd"), F.min("_y").alias("min"), F.max("_y").alias("max"))


def tukey_pairs(df: DataFrame, y: str, factor: str) -> DataFrame:
    """(level_a, level_b, diff, q, p) of all pairs of levels, p from the studentised range (Tukey-Kramer).

    Group moments are aggregated first; the pairs are a join of that table with itself, a row a pair.
    Null readings and levels are left out; with no scatter left, q and p are null.
    """
    grp = df.filter(F.col(y).isNotNull() & F.col(factor).isNotNull()).groupBy(F.col(factor).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
    grp = cut_lineage(grp, "levels")
    s = grp.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ss")).first()
    free = float((s["n"] or 0) - s["k"])
    s2 = s["ss"] / free if free > 0 else 0.0
    a = grp.select(F.col("level").alias("level_a"), F.col("n").alias("na"), F.col("m").alias("ma"))
    b = grp.select(F.col("level").alias("level_b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    diff = F.col("mb") - F.col("ma")
    q = F.when(F.lit(s2 > 0), F.abs(diff) / F.sqrt(F.lit(s2 / 2) * (1 / F.col("na") + 1 / F.col("nb"))))
    pairs = a.join(b, F.col("level_a") < F.col("level_b")).select("level_a", "level_b", diff.alias("diff"), q.alias("q"))
    p = range_pvalue("q", F.lit(float(s["k"])), F.lit(free))
    return pairs.withColumn("p", p).withColumn("p", F.when(~F.isnan("p"), F.col("p")))
