"""Differential expression and abundance on the driver's tables."""

from pyspark.sql import functions as F

from fenloom.operators import expression as V
from fenloom.operators import mixed as X
from fenloom.plans import roles
from fenloom.plans.models import SHEET, sheet
from fenloom.plans.registry import query, rnd, with_
from fenloom.plans.roles import COUNTS, PART_COUNTS, TAXONOMY, r6, rounded, table

GROUPS = ["CommA", "CommB", "CommC"]

@query("v1_prep_tpm", """
WITH t AS (SELECT l_partkey AS feature_id, concat('s', l_suppkey, CASE WHEN n_name = 'NATION_3' THEN '_neg' ELSE '' END) AS sample_id,
  sum(l_quantity) / 4 AS abundance, any_value(p_retailprice) AS length
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)
SELECT feature_id, sample_id, round(round_even(abundance, 0) + 0.1, 6) AS abundance FROM t
WHERE length >= 950 AND NOT regexp_matches(sample_id, 'neg')""")
def v1(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg((F.sum("l_quantity") / 4).alias("abundance"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("length"))
    sup = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")
    ).select(F.col("s_suppkey").alias("l_suppkey"), F.concat(
        F.lit("s"), "s_suppkey", F.when(F.col("n_name") == "NATION_3", "_neg").otherwise(""), F.lit(".aligned")
    ).alias("sample_id"))
    tpm = li.join(part, "l_partkey").join(sup, "l_suppkey").select(
        F.col("l_partkey").alias("feature_id"), "sample_id", "abundance", "length")
    return rounded(V.prep_tpm(tpm, min_length=950), "abundance")


TMM = """nf AS (SELECT count(DISTINCT feature_id) AS nf FROM counts),
lib AS (SELECT sample_id, sum(abundance) AS total FROM counts GROUP BY 1),
dense AS (SELECT s.sample_id, f.feature_id, coalesce(c.abundance, 0) AS y FROM lib s
  CROSS JOIN (SELECT DISTINCT feature_id FROM counts) f LEFT JOIN counts c USING (sample_id, feature_id)),
uq AS (SELECT sample_id, quantile_cont(y, 0.75) / any_value(total) AS q FROM dense JOIN lib USING (sample_id) GROUP BY 1),
ref AS (SELECT sample_id AS rid FROM uq, (SELECT avg(q) AS mq FROM uq) ORDER BY round(abs(q - mq), 12), sample_id LIMIT 1),
rr AS (SELECT feature_id, abundance AS yr, total AS nr FROM counts JOIN lib USING (sample_id) JOIN ref ON rid = sample_id),
ma AS (SELECT sample_id, feature_id, round(log2((abundance / total) / (yr / nr)), 10) AS m,
  round((log2(abundance / total) + log2(yr / nr)) / 2, 10) AS a,
  (total - abundance) / total / abundance + (nr - yr) / nr / yr AS v
  FROM counts JOIN lib USING (sample_id) JOIN rr USING (feature_id)),
rk AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS k,
  rank() OVER (PARTITION BY sample_id ORDER BY m) + (count(*) OVER (PARTITION BY sample_id, m) - 1) / 2 AS rm,
  rank() OVER (PARTITION BY sample_id ORDER BY a) + (count(*) OVER (PARTITION BY sample_id, a) - 1) / 2 AS ra FROM ma),
raw AS (SELECT sample_id, sum(m / v) / sum(1 / v) AS lf FROM rk
  WHERE rm BETWEEN floor(k * 0.3) + 1 AND k - floor(k * 0.3) AND ra BETWEEN floor(k * 0.05) + 1 AND k - floor(k * 0.05)
  GROUP BY 1),
fac AS (SELECT sample_id, total, power(2, coalesce(lf, 0) - avg(coalesce(lf, 0)) OVER ()) AS factor
  FROM lib LEFT JOIN raw USING (sample_id))"""


@query("v2_tmm_factors", with_(COUNTS, TMM, body=f"""
SELECT sample_id, total, {rnd('factor')} AS factor FROM fac"""))
def v2(spark, sf):
    return rounded(V.tmm_factors(roles.counts(spark, sf)), "factor")


VOOM = """ec AS (SELECT sample_id, total * factor + 1 AS eff FROM fac),
ev AS (SELECT feature_id, sample_id, treatment AS g, log2((y + 0.5) / eff * 1e6) AS e, eff
  FROM dense JOIN ec USING (sample_id) JOIN sheet USING (sample_id)),
fit AS (SELECT feature_id, g, count(*) AS n, avg(e) AS m, coalesce(var_samp(e), 0) AS v FROM ev GROUP BY 1, 2),
per AS (SELECT feature_id, sum(n * m) / sum(n) AS mean, sqrt(sum((n - 1) * v) / (sum(n) - count(*))) AS sd FROM fit GROUP BY 1),
pts AS (SELECT round(mean + sh, 9) AS sx, sqrt(sd) AS sy FROM per, (SELECT avg(log2(eff)) - log2(1e6) AS sh FROM ec)),
bins AS (SELECT bin, avg(sx) AS x, avg(sy) AS y, row_number() OVER (ORDER BY bin) AS kn FROM
  (SELECT *, floor((rank() OVER (ORDER BY sx) - 1) * 20 / count(*) OVER ()) AS bin FROM pts) GROUP BY 1),
seg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY kn) AS x1, lead(y) OVER (ORDER BY kn) AS y1 FROM bins),
ends AS (SELECT min(x) AS xlo, max(x) AS xhi, arg_min(y, x) AS ylo, arg_max(y, x) AS yhi FROM bins),
pt AS (SELECT feature_id, sample_id, g, e, m + log2(eff) - log2(1e6) AS x FROM ev JOIN fit USING (feature_id, g)),
vw AS (SELECT pt.feature_id, pt.sample_id, pt.g, pt.e, power(CASE WHEN x <= xlo THEN ylo WHEN x > xhi THEN yhi
  ELSE y0 + (x - x0) * (y1 - y0) / (x1 - x0) END, -4) AS w
  FROM pt CROSS JOIN ends LEFT JOIN seg ON x > x0 AND x <= x1)"""


def voomed(spark, sf):
    c = roles.counts(spark, sf)
    return V.voom(c, V.tmm_factors(c), sheet(spark, sf), "treatment")


@query("v3_voom", with_(COUNTS, SHEET, TMM, VOOM, body=f"""
SELECT feature_id, sample_id, g AS "group", {rnd('e')} AS e, {rnd('w', 4)} AS weight FROM vw"""))
def v3(spark, sf):
    return rounded(rounded(voomed(spark, sf), "e"), "weight", digits=4)


CONTRAST = """cg AS (SELECT feature_id, g, count(*) AS n, sum(w) AS sw, sum(w * e) AS swe, sum(w * e * e) AS swee, sum(e) AS se
  FROM vw GROUP BY 1, 2),
cp AS (SELECT feature_id, sum(se) / sum(n) AS ave, (sum(n) - count(*))::BIGINT AS df,
  sum(greatest(swee - swe * swe / sw, 0)) AS rss, max(CASE WHEN g = 'CommA' THEN swe / sw END) AS ma,
  max(CASE WHEN g = 'CommB' THEN swe / sw END) AS mb, max(CASE WHEN g = 'CommC' THEN swe / sw END) AS mc,
  max(CASE WHEN g = 'CommA' THEN 1 / sw END) AS ua, max(CASE WHEN g = 'CommB' THEN 1 / sw END) AS ub,
  max(CASE WHEN g = 'CommC' THEN 1 / sw END) AS uc FROM cg GROUP BY 1),
con AS (SELECT feature_id, 'TestCommA' AS contrast, ma - (mb + mc) / 2 AS fc, sqrt(ua + (ub + uc) / 4) AS un, ave, rss / df AS s2, df FROM cp
  UNION ALL SELECT feature_id, 'TestCommB', mb - (ma + mc) / 2, sqrt(ub + (ua + uc) / 4), ave, rss / df, df FROM cp
  UNION ALL SELECT feature_id, 'TestCommC', mc - (mb + ma) / 2, sqrt(uc + (ub + ua) / 4), ave, rss / df, df FROM cp)"""


@query("v4_contrasts", with_(COUNTS, SHEET, TMM, VOOM, CONTRAST, body=f"""
SELECT feature_id, contrast, {rnd('fc', 5)} AS log_fc, {rnd('ave', 5)} AS ave_expr, {rnd('un', 5)} AS unscaled,
  {rnd('s2', 5)} AS s2, df FROM con"""))
def v4(spark, sf):
    fit = V.contrasts(voomed(spark, sf), V.one_against_rest(GROUPS))
    return rounded(fit, "log_fc", "ave_expr", "unscaled", "s2", digits=5)


def moderated(spark, sf):
    return V.ebayes(V.contrasts(voomed(spark, sf), V.one_against_rest(GROUPS)))


@query("v5_v6_moderated_top_table")
def v5(spark, sf):
    out = V.top_table(moderated(spark, sf), "TestCommA")
    return rounded(out.select("feature_id", "contrast", "log_fc", "ave_expr", "t", "p", "padj"),
                   "log_fc", "ave_expr", "t", "p", "padj")


def plant_fits(spark, sf):
    """Contrasts of the weighted log counts with a random intercept per block of the sample sheet."""
    blocks = sheet(spark, sf).select("sample_id", "block")
    return X.block_contrasts(voomed(spark, sf).join(F.broadcast(blocks), "sample_id"), V.one_against_rest(GROUPS))


@query("v4_plant_contrasts")
def v4_plant(spark, sf):
    return rounded(plant_fits(spark, sf), "log_fc", "ave_expr", "unscaled", "s2", "df", "df_s2", "ratio", digits=5)


@query("v5_plant_top_table")
def v5_plant(spark, sf):
    out = V.top_table(X.moderate(plant_fits(spark, sf)), "TestCommA")
    return rounded(out.select("feature_id", "contrast", "log_fc", "ave_expr", "t", "df_total", "p", "padj"),
                   "log_fc", "ave_expr", "t", "df_total", "p", "padj")


# p-values made from hashes of the part key, so that SQL can follow the later steps
RES = """res0 AS (SELECT p_partkey AS feature_id, c AS contrast,
  power((('0x' || substr(md5(concat_ws('|', c, p_partkey)), 1, 8))::BIGINT // 1048576) / 4096.0::DOUBLE, 4) AS p,
  (p_size - 25.5) / 4 AS log_fc, p_retailprice / 200 AS ave_expr
  FROM part, (SELECT unnest(['CommA', 'CommB', 'CommC']) AS c)),
res1 AS (SELECT *, p * count(*) OVER (PARTITION BY contrast)
  / max(rn) OVER (PARTITION BY contrast, p) AS q FROM (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY p) AS rn FROM res0)),
res AS (SELECT feature_id, contrast, p, log_fc, ave_expr, least(1.0::DOUBLE, min(q) OVER (PARTITION BY contrast ORDER BY p DESC
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj FROM res1)"""


def results(spark, sf):
    from fenloom.functions.scalar import hash32

    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("feature_id"), ((F.col("p_size") - 25.5) / 4).alias("log_fc"),
        (F.col("p_retailprice") / 200).alias("ave_expr"))
    long = part.withColumn("contrast", F.explode(F.array(*[F.lit(g) for g in GROUPS])))
    u = F.floor(hash32("contrast", "feature_id") / 1048576) / F.lit(4096.0)
    return V.bh_adjust(long.withColumn("p", F.pow(u, F.lit(4.0))), "p", ["contrast"])


@query("v7_bh_adjust", with_(RES, body=f"""
SELECT feature_id, contrast, {rnd('p', 9)} AS p, {rnd('padj', 9)} AS padj FROM res"""))
def v7(spark, sf):
    return rounded(results(spark, sf).select("feature_id", "contrast", "p", "padj"), "p", "padj", digits=9)


STATUS = """CASE WHEN log_fc > 0 AND padj < 0.05 THEN 'up' WHEN log_fc < 0 AND padj < 0.05 THEN 'down' ELSE 'not.signif' END"""


@query("v8_status", with_(RES, body=f"SELECT contrast, {STATUS} AS status, count(*) AS n FROM res GROUP BY 1, 2"))
def v8(spark, sf):
    return results(spark, sf).withColumn("status", V.call_status()).groupBy("contrast", "status").agg(
        F.count(F.lit(1)).alias("n"))


ANN = """ann AS (SELECT p_partkey AS feature_id, p_brand AS ko, p_name AS ko_definition FROM part WHERE p_type <> 'PROMO')"""


def annotation(spark, sf):
    return table(spark, sf, "part").filter("p_type <> 'PROMO'").select(
        F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("ko"), F.col("p_name").alias("ko_definition"))


@query("v9_ma_table", with_(RES, ANN, f"s AS (SELECT *, {STATUS} AS status FROM res WHERE contrast = 'CommA')",
    """o AS (SELECT *, CASE WHEN status <> 'not.signif' THEN feature_id END AS delabel,
  CASE WHEN (abs(log_fc) >= 6 OR ave_expr > 6) AND status <> 'not.signif' THEN feature_id END AS outlier FROM s)""",
    body="""SELECT feature_id, status, delabel, outlier, CASE WHEN outlier IS NOT NULL THEN ko END AS ko,
  CASE WHEN outlier IS NOT NULL THEN ko_definition END AS ko_definition FROM o LEFT JOIN ann USING (feature_id)"""))
def v9(spark, sf):
    out = V.ma_table(results(spark, sf).filter("contrast = 'CommA'"), annotation(spark, sf), ["ko", "ko_definition"])
    return out.select("feature_id", "status", "delabel", "outlier", "ko", "ko_definition")


@query("v10_deg_expression", with_(PART_COUNTS, RES, ANN, body="""
SELECT feature_id, sample_id, abundance, ko, ko_definition FROM pcounts LEFT JOIN ann USING (feature_id)
WHERE feature_id IN (SELECT feature_id FROM res WHERE padj < 0.05 AND abs(log_fc) > 4)"""))
def v10(spark, sf):
    return V.deg_expression(results(spark, sf), roles.part_counts(spark, sf), annotation(spark, sf))


LLBC = """pos AS (SELECT feature_id, treatment AS g, ln(abundance + 1) AS x FROM pcounts JOIN sheet USING (sample_id) WHERE abundance > 0),
sz AS (SELECT sum(CASE WHEN treatment = 'CommA' THEN 1 ELSE 0 END)::BIGINT AS na, sum(CASE WHEN treatment = 'CommB' THEN 1 ELSE 0 END)::BIGINT AS nb,
  sum(CASE WHEN treatment = 'CommC' THEN 1 ELSE 0 END)::BIGINT AS nc FROM sheet),
lp AS (SELECT feature_id, count(*) AS seen, coalesce(sum(x) FILTER (WHERE g = 'CommA'), 0) AS sa, coalesce(sum(x * x) FILTER (WHERE g = 'CommA'), 0) AS qa,
  coalesce(sum(x) FILTER (WHERE g = 'CommB'), 0) AS sb, coalesce(sum(x * x) FILTER (WHERE g = 'CommB'), 0) AS qb,
  coalesce(sum(x) FILTER (WHERE g = 'CommC'), 0) AS sc, coalesce(sum(x * x) FILTER (WHERE g = 'CommC'), 0) AS qc FROM pos GROUP BY 1),
lq AS (SELECT *, greatest(qa - sa * sa / na + qb - sb * sb / nb + qc - sc * sc / nc, 0) / (na + nb + nc - 3) AS s2
  FROM lp, sz WHERE seen / (na + nb + nc) >= 0.3),
ll AS (SELECT feature_id, 'CommB_vs_CommA' AS contrast, sb / nb - sa / na AS raw, sqrt(s2 * (1 / na + 1 / nb)) AS se, na + nb + nc - 3 AS df FROM lq
  UNION ALL SELECT feature_id, 'CommC_vs_CommA', sc / nc - sa / na, sqrt(s2 * (1 / na + 1 / nc)), na + nb + nc - 3 FROM lq
  UNION ALL SELECT feature_id, 'CommC_vs_CommB', sc / nc - sb / nb, sqrt(s2 * (1 / nb + 1 / nc)), na + nb + nc - 3 FROM lq),
llb AS (SELECT contrast, quantile_cont(raw, 0.5) AS bias FROM ll GROUP BY 1)"""


@query("v11_log_linear_bc", with_(PART_COUNTS, SHEET, LLBC, body=f"""
SELECT feature_id, contrast, {rnd('raw - bias')} AS lfc, {rnd('se')} AS se, {rnd('bias')} AS bias,
  {rnd('(raw - bias) / nullif(se, 0)')} AS w, df FROM ll JOIN llb USING (contrast)"""))
def v11(spark, sf):
    out = V.log_linear_bc(roles.part_counts(spark, sf), sheet(spark, sf), "treatment", GROUPS).drop("precision")
    return rounded(out, "lfc", "se", "bias", "w")


def differential(spark, sf):
    return V.diff_abundance(roles.part_counts(spark, sf), sheet(spark, sf), "treatment", GROUPS)


@query("v11_differential_pvalues")
def v11p(spark, sf):
    out = differential(spark, sf).select("feature_id", "contrast", "lfc", "p", "q", "diff")
    return rounded(out, "lfc", "p", "q")


# with three groups the tail of F is a power
@query("v11_global_test", with_(PART_COUNTS, SHEET, LLBC, """gl AS (
  SELECT feature_id, sum(power(raw - bias, 2) * CASE contrast WHEN 'CommB_vs_CommA' THEN na * nb WHEN 'CommC_vs_CommA' THEN na * nc ELSE nb * nc END
    / (na + nb + nc)::DOUBLE / nullif(s2, 0)) / 2 AS f, max(df) AS df FROM ll JOIN llb USING (contrast) JOIN lq USING (feature_id) GROUP BY 1)""",
    body=f"""SELECT feature_id, {rnd('f')} AS f, df, {rnd('power(1 + 2 * f / df, -df / 2)')} AS p FROM gl"""))
def v11g(spark, sf):
    fit = V.log_linear_bc(roles.part_counts(spark, sf), sheet(spark, sf), "treatment", GROUPS)
    return rounded(V.global_test(fit, 3), "f", "p")


@query("v12_any_difference", with_(RES, body="SELECT DISTINCT feature_id FROM res WHERE padj < 0.05"))
def v12(spark, sf):
    return V.any_diff(results(spark, sf).withColumn("diff", F.col("padj") < 0.05))


@query("v13_difference_table", with_(PART_COUNTS, SHEET, RES, TAXONOMY, body="""
SELECT feature_id, sample_id, abundance, day, lineage FROM pcounts JOIN sheet USING (sample_id) JOIN taxonomy USING (feature_id)
WHERE feature_id IN (SELECT feature_id FROM res WHERE padj < 0.05) AND day IN ('d1') AND treatment <> 'CommC'"""))
def v13(spark, sf):
    sig = V.any_diff(results(spark, sf).withColumn("diff", F.col("padj") < 0.05))
    return V.diff_table(sig, roles.taxonomy(spark, sf), roles.part_counts(spark, sf), sheet(spark, sf), ["d1"], "day",
                        F.col("treatment") == "CommC")


NAMED = """named AS (SELECT concat('RNA', l_suppkey, '_P', l_suppkey, '_', CASE r_name WHEN 'AFRICA' THEN 'M01' WHEN 'ASIA' THEN 'M06'
    WHEN 'EUROPE' THEN 'M09' ELSE 'M00' END, '_WK', CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 4 ELSE 9 END) AS sample_id,
  p_name AS ko_definition, sum(l_quantity) AS abundance FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2)"""


def named(spark, sf):
    code = F.when(F.col("treatment") == "AFRICA", "M01").when(F.col("treatment") == "ASIA", "M06").when(
        F.col("treatment") == "EUROPE", "M09").otherwise("M00")
    week = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 4).otherwise(9)
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("ko_definition"))
    s = roles.samples(spark, sf).select(F.col("sample_id").alias("l_suppkey"), "treatment")
    name = F.concat(F.lit("RNA"), "l_suppkey", F.lit("_P"), "l_suppkey", F.lit("_"), code, F.lit("_WK"), week)
    return li.join(part, "l_partkey").join(s, "l_suppkey").groupBy(name.alias("sample_id"), "ko_definition").agg(
        F.sum("q").alias("abundance"))


@query("v14_heat_table", with_(NAMED, "cells AS (SELECT ko_definition, sample_id, log2(sum(abundance) + 0.5) AS l FROM named GROUP BY 1, 2)",
    "tot AS (SELECT ko_definition, sum(l) AS row_total FROM cells GROUP BY 1)", body=f"""
SELECT ko_definition, sample_id, {rnd('l')} AS log2, {rnd('row_total')} AS row_total FROM cells JOIN tot USING (ko_definition)
WHERE NOT regexp_matches(sample_id, '_WK4')"""))
def v14(spark, sf):
    return rounded(V.heat_table(named(spark, sf), "ko_definition", "_WK4"), "log2", "row_total")


DECODE = """dec AS (SELECT *, split_part(sample_id, '_', 1) AS sample, split_part(sample_id, '_', 2) AS plant,
  CASE split_part(sample_id, '_', 3) WHEN 'M01' THEN 'CommA' WHEN 'M06' THEN 'CommB' WHEN 'M09' THEN 'CommC' END AS treatment,
  split_part(sample_id, '_', 4) AS week,
  CASE split_part(sample_id, '_', 4) WHEN 'WK1' THEN 1 WHEN 'WK4' THEN 22 WHEN 'WK9' THEN 55 END AS day FROM named)"""


def decoded(spark, sf):
    return V.decode_sample(named(spark, sf), "sample_id", {"M01": "CommA", "M06": "CommB", "M09": "CommC"},
                           {"WK1": 1, "WK4": 22, "WK9": 55})


@query("v15_function_table", with_(NAMED, DECODE, body=f"""
SELECT sample_id, ko_definition, treatment, day, {rnd('log2(abundance + 0.5)')} AS log2_tpm FROM dec
WHERE regexp_matches(ko_definition, '(?i)GEAR|bolt') AND week <> 'WK4'"""))
def v15(spark, sf):
    out = V.function_table(decoded(spark, sf), "ko_definition", "GEAR|bolt", "WK4")
    return rounded(out, "log2_tpm").select("sample_id", "ko_definition", "treatment", "day", "log2_tpm")


@query("v16_decode_sample", with_(NAMED, DECODE, body="""
SELECT sample, plant, treatment, week, day, count(*) AS n, sum(abundance) AS abundance FROM dec GROUP BY 1, 2, 3, 4, 5"""))
def v16(spark, sf):
    return decoded(spark, sf).groupBy("sample", "plant", "treatment", "week", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("abundance").alias("abundance"))


HITS = """hits AS (SELECT concat('c_', l_partkey, '_', l_linenumber) AS query, p_brand AS "KO", l_extendedprice / 100 AS score,
  l_discount / 20 AS evalue FROM lineitem JOIN part ON p_partkey = l_partkey),
best AS (SELECT concat_ws('_', split_part(query, '_', 1), split_part(query, '_', 2)) AS gene_name, "KO", score, evalue FROM hits
  WHERE evalue < 0.001 AND score > 99 QUALIFY rank() OVER (PARTITION BY gene_name ORDER BY score DESC) = 1)"""


def hits(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_extendedprice", "l_discount")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("KO"))
    return li.join(part, "l_partkey").select(
        F.concat(F.lit("c_"), "l_partkey", F.lit("_"), "l_linenumber").alias("query"), "KO",
        (F.col("l_extendedprice") / 100).alias("score"), (F.col("l_discount") / 20).alias("evalue"))


@query("v17_best_hits", with_(HITS, body=f"""
SELECT gene_name, "KO", {rnd('score')} AS score, {rnd('evalue')} AS evalue FROM best"""))
def v17(spark, sf):
    return rounded(V.best_hits(hits(spark, sf)), "score", "evalue")


HIER = """hier AS (SELECT DISTINCT p_type AS "L1", p_container AS "L2", p_brand AS "L3", concat(p_brand, ' ', p_type) AS "L4"
  FROM (SELECT *, 'x' AS p_container FROM part) WHERE p_brand <> 'Brand#7')"""


@query("v18_annotate_ko", with_(HITS, HIER, body="""
SELECT gene_name, best."KO", "L1", "L3", "L4" FROM best JOIN hier ON split_part("L4", ' ', 1) = best."KO" """))
def v18(spark, sf):
    hier = table(spark, sf, "part").filter("p_brand <> 'Brand#7'").select(
        F.col("p_type").alias("L1"), F.col("p_brand").alias("L3"), F.concat_ws(" ", "p_brand", "p_type").alias("L4")
    ).distinct()
    return V.annotate_ko(V.best_hits(hits(spark, sf)), hier).select("gene_name", "KO", "L1", "L3", "L4")


@query("v19_genome_functions", """
WITH h AS (SELECT l_partkey AS gene_name, concat('k141_', l_orderkey) AS contig, concat('bin_', s_nationkey) AS bin
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
f AS (SELECT gene_name, contig, bin, p_name AS "KO_definition" FROM h JOIN part ON p_partkey = gene_name
  WHERE p_type <> 'PROMO' AND regexp_matches(p_name, '(?i)GEAR|bolt')),
t AS (SELECT *, concat('MAG', n_nationkey, '-', n_name) AS mag_species,
  CASE WHEN regexp_matches("KO_definition", 'gear') THEN 'Protease' WHEN regexp_matches("KO_definition", 'red') THEN 'Chitinase' END AS broad_class
  FROM f JOIN nation ON bin = concat('bin_', n_nationkey))
SELECT gene_name, contig, mag_species, "KO_definition", broad_class, count(*) OVER (PARTITION BY mag_species, "KO_definition") AS value,
  count(*) OVER (PARTITION BY mag_species, broad_class) AS value_class FROM t""")
def v19(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey")
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    h = li.join(sup, "l_suppkey").select(
        F.col("l_partkey").alias("gene_name"),
        F.concat(F.lit("k141_"), "l_orderkey", F.lit("_bin_"), "s_nationkey").alias("contig_bin"))
    fun = table(spark, sf, "part").select(
        F.col("p_partkey").alias("gene_name"), F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("KO"),
        F.col("p_name").alias("KO_definition"))
    tax = table(spark, sf, "nation").select(
        F.concat(F.lit("bin_"), "n_nationkey").alias("bin"), F.concat(F.lit("MAG"), "n_nationkey").alias("new_bin"),
        F.col("n_name").alias("species"))
    out = V.mag_functions(h, fun, tax, "GEAR|bolt", [("gear", "Protease"), ("red", "Chitinase")])
    return out.select("gene_name", "contig", "mag_species", "KO_definition", "broad_class", "value", "value_class")
