"""Count-table operators on supplier x part counts."""

from pyspark.sql import functions as F

from fenloom.operators import community as C
from fenloom.operators import distance as D
from fenloom.plans import roles
from fenloom.plans.registry import query, rnd, with_
from fenloom.plans.roles import COUNTS, PART_COUNTS, SAMPLES, TAXONOMY, r6, rounded, table

DEPTH = 14500
SEED = roles.DRAW_SEED

GENUS = """genus_of AS (SELECT feature_id,
  coalesce(nullif(regexp_replace(trim(string_split(lineage, ';')[6]), '^[a-z]__', ''), ''), 'Unknown') AS genus
  FROM taxonomy)"""


@query("a5_collapse_rank", with_(PART_COUNTS, TAXONOMY, GENUS, body="""
SELECT sample_id, genus AS feature_id, sum(abundance) AS abundance
FROM pcounts JOIN genus_of USING (feature_id) GROUP BY 1, 2"""))
def a5(spark, sf):
    return C.collapse(roles.part_counts(spark, sf), roles.taxonomy(spark, sf), "genus")


@query("f9_filter_low_counts", with_(PART_COUNTS, body="SELECT * FROM pcounts WHERE abundance >= 40"))
def f9(spark, sf):
    return C.filter_low_counts(roles.part_counts(spark, sf), 40)


@query("w7_to_relative", with_(PART_COUNTS, body=f"""
SELECT sample_id, feature_id, {rnd('100 * abundance / sum(abundance) OVER (PARTITION BY sample_id)')} AS abundance
FROM pcounts"""))
def w7(spark, sf):
    return rounded(C.to_relative(roles.part_counts(spark, sf), 100), "abundance")


@query("o2_order_features", with_(PART_COUNTS, body="""
SELECT feature_id, sum(abundance) AS total FROM pcounts GROUP BY 1 ORDER BY 2 DESC, 1"""))
def o2(spark, sf):
    return C.order_features(roles.part_counts(spark, sf))


@query("o3_top_n_other", with_(COUNTS, """tot AS (
  SELECT feature_id, sum(abundance) AS t FROM counts WHERE feature_id <> 'red bolt' GROUP BY 1
  ORDER BY t DESC, feature_id LIMIT 20)""", """folded AS (
  SELECT sample_id, CASE WHEN feature_id IN (SELECT feature_id FROM tot) THEN feature_id ELSE 'other' END AS feature_id,
    sum(abundance) AS a FROM counts GROUP BY 1, 2)""", body=f"""
SELECT sample_id, feature_id, {rnd('a / sum(a) OVER (PARTITION BY sample_id)')} AS abundance FROM folded"""))
def o3(spark, sf):
    return rounded(C.top_n_other(roles.counts(spark, sf), 20, force_other=("red bolt",)), "abundance")


@query("o4_top_features", with_(PART_COUNTS, TAXONOMY, """top AS (
  SELECT feature_id, sum(abundance) AS total FROM pcounts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)""",
    body="SELECT feature_id, total, " + ", ".join(
    f"nullif(regexp_replace(trim(string_split(lineage, ';')[{i + 1}]), '^[a-z]__', ''), '') AS {r}"
    for i, r in enumerate(("domain", "phylum", '"class"', '"order"', "family", "genus", "species")))
    + " FROM top JOIN taxonomy USING (feature_id)"))
def o4(spark, sf):
    return C.top_features(roles.part_counts(spark, sf), roles.taxonomy(spark, sf))


BAR = with_(PART_COUNTS, SAMPLES, TAXONOMY, GENUS, """grp AS (
  SELECT sample_id, concat_ws('.', treatment, block) AS "group" FROM samples
  WHERE sample_id IN (SELECT sample_id FROM pcounts))""", """means AS (
  SELECT "group", feature_id, sum(abundance) / any_value(n) AS a
  FROM pcounts JOIN grp USING (sample_id) JOIN (SELECT "group", count(*) AS n FROM grp GROUP BY 1) USING ("group")
  GROUP BY 1, 2)""", """g AS (
  SELECT "group", genus, sum(a) AS a FROM means JOIN genus_of USING (feature_id) GROUP BY 1, 2)""", """top AS (
  SELECT genus FROM g WHERE genus <> 'Unknown' GROUP BY 1 ORDER BY sum(a) DESC, genus LIMIT 5)""", """folded AS (
  SELECT "group", CASE WHEN genus IN (SELECT genus FROM top) THEN genus ELSE 'other' END AS feature_id, sum(a) AS a
  FROM g GROUP BY 1, 2)""", """shares AS (
  SELECT "group", feature_id, a / sum(a) OVER (PARTITION BY "group") AS abundance FROM folded)""", """pos AS (
  SELECT feature_id, row_number() OVER (ORDER BY CASE WHEN feature_id = 'other' THEN 0 ELSE 1 END,
    round(sum(abundance), 9), feature_id) - 1 AS position FROM shares GROUP BY 1)""", body=f"""
SELECT "group", feature_id, {rnd('abundance')} AS abundance, position FROM shares JOIN pos USING (feature_id)""")


@query("e21_bar_table", BAR)
def e21(spark, sf):
    out = C.bar_table(roles.part_counts(spark, sf), roles.taxonomy(spark, sf), roles.samples(spark, sf),
                      "genus", ["treatment", "block"], 5)
    return rounded(out, "abundance").select("group", "feature_id", "abundance", "position")


@query("e1_rarefy", with_(PART_COUNTS, """deep AS (
  SELECT sample_id FROM pcounts GROUP BY 1 HAVING sum(abundance) >= 14500)""", """each AS (
  SELECT sample_id, feature_id, unnest(range(1, CAST(abundance AS BIGINT) + 1)) AS i
  FROM pcounts WHERE sample_id IN (SELECT sample_id FROM deep))""", """pick AS (
  SELECT sample_id, feature_id, row_number() OVER (PARTITION BY sample_id
    ORDER BY md5(concat_ws('|', '1115', sample_id, feature_id, i))) AS r FROM each)""", body="""
SELECT sample_id, feature_id, count(*) AS abundance FROM pick WHERE r <= 14500 GROUP BY 1, 2"""))
def e1(spark, sf):
    return C.rarefy(roles.part_counts(spark, sf), DEPTH, SEED)


DIV = """div AS (
  SELECT sample_id, count(*) AS richness, -sum(p * ln(p)) AS shannon, exp(-sum(p * ln(p))) AS effective
  FROM (SELECT sample_id, abundance / sum(abundance) OVER (PARTITION BY sample_id) AS p FROM pcounts) GROUP BY 1)"""


@query("e2_e3_e4_diversity", with_(PART_COUNTS, DIV, body=f"""
SELECT sample_id, richness, {rnd('shannon')} AS shannon, round_even(round(effective, 9), 0) AS effective_species
FROM div"""))
def e2(spark, sf):
    return rounded(C.diversity(roles.part_counts(spark, sf)), "shannon")


@query("e5_diversity_with_metadata", with_(PART_COUNTS, DIV, SAMPLES, body=f"""
SELECT treatment, block, count(*) AS n, {rnd('avg(richness)')} AS richness, {rnd('avg(shannon)')} AS shannon
FROM samples JOIN div USING (sample_id) GROUP BY 1, 2"""))
def e5(spark, sf):
    md = C.with_diversity(roles.samples(spark, sf), roles.part_counts(spark, sf))
    return md.groupBy("treatment", "block").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("richness")).alias("richness"), r6(F.avg("shannon")).alias("shannon"))


@query("e6_bray_curtis", with_(PART_COUNTS, """tot AS (SELECT sample_id, sum(abundance) AS t FROM pcounts GROUP BY 1)""",
    """num AS (SELECT a.sample_id AS i, b.sample_id AS j, sum(least(a.abundance, b.abundance)) AS s
  FROM pcounts a JOIN pcounts b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY 1, 2)""",
    body=f"""SELECT a.sample_id AS i, b.sample_id AS j, {rnd('1 - 2 * coalesce(s, 0) / (a.t + b.t)')} AS d
FROM tot a JOIN tot b ON a.sample_id < b.sample_id LEFT JOIN num ON num.i = a.sample_id AND num.j = b.sample_id"""))
def e6(spark, sf):
    return rounded(D.bray_curtis(roles.part_counts(spark, sf)), "d")


@query("e7_euclidean", """
SELECT a.s_suppkey AS i, b.s_suppkey AS j, (round(sqrt(power(a.s_acctbal - b.s_acctbal, 2)), 6) + 0.0::DOUBLE) AS d
FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey""")
def e7(spark, sf):
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), "s_acctbal")
    return rounded(D.euclidean(df, ["s_acctbal"]), "d")


@query("e7_euclidean_vectors", """
SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.e, b.e), 6) AS d
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a
JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id < b.vec_id""")
def e7v(spark, sf):
    df = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(D.euclidean_vectors(df), "d")


CLOSURE = """closure AS (
  SELECT concat('t', p_partkey) AS tip, concat('t', p_partkey) AS node, 1.0::DOUBLE AS length FROM part
  UNION ALL SELECT concat('t', p_partkey), concat('g', p_type, '/', p_brand), 0.5 + p0.len FROM part JOIN
    (SELECT p_type AS pt, p_brand AS pb, min(p_size) / 50 AS len FROM part GROUP BY 1, 2) p0
    ON pt = p_type AND pb = p_brand
  UNION ALL SELECT concat('t', p_partkey), concat('d', p_type), 2.0 FROM part)"""


def tree_edges(spark, sf):
    """Type -> brand -> part as a tree with unequal branch lengths."""
    part = table(spark, sf, "part")
    d, g = F.concat(F.lit("d"), "p_type"), F.concat(F.lit("g"), "p_type", F.lit("/"), "p_brand")
    root = part.select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"),
                       F.lit(None).cast("double").alias("branch_length")).limit(1)
    tips = part.select(F.concat(F.lit("t"), "p_partkey").alias("node"), g.alias("parent"),
                       F.lit(1.0).alias("branch_length"))
    mids = part.groupBy(g.alias("node"), d.alias("parent")).agg((0.5 + F.min("p_size") / 50).alias("branch_length"))
    tops = part.select(d.alias("node"), F.lit("root").alias("parent"), F.lit(2.0).alias("branch_length")).distinct()
    return root.unionByName(tips).unionByName(mids).unionByName(tops)


@query("e9_tree_closure", with_(CLOSURE, body=f"""
SELECT tip, node, {rnd('length')} AS length FROM closure
WHERE tip IN (SELECT concat('t', l_partkey) FROM lineitem WHERE l_quantity >= 49)"""))
def e9(spark, sf):
    tips = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(
        F.concat(F.lit("t"), "l_partkey").alias("tip")).distinct()
    return rounded(C.prune_tree(C.tip_closure(tree_edges(spark, sf)), tips), "length")


@query("e8_unifrac", with_(CLOSURE, """pres AS (
  SELECT DISTINCT l_suppkey AS s, node, length FROM lineitem JOIN closure ON tip = concat('t', l_partkey))""", """tot AS (SELECT s, sum(length) AS t FROM pres GROUP BY 1)""", """num AS (
  SELECT a.s AS i, b.s AS j, sum(a.length) AS sh FROM pres a JOIN pres b ON a.node = b.node AND a.s < b.s GROUP BY 1, 2)""",
    body=f"""SELECT a.s AS i, b.s AS j, {rnd('(a.t + b.t - 2 * coalesce(sh, 0)) / (a.t + b.t - coalesce(sh, 0))')} AS d
FROM tot a JOIN tot b ON a.s < b.s LEFT JOIN num ON num.i = a.s AND num.j = b.s"""))
def e8(spark, sf):
    counts = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"), F.concat(F.lit("t"), "l_partkey").alias("feature_id"),
        F.lit(1).alias("abundance"))
    return rounded(D.unifrac(counts, C.tip_closure(tree_edges(spark, sf))), "d")


@query("e19_contaminants", with_(PART_COUNTS, SAMPLES, """n AS (
  SELECT sum(CASE WHEN treatment = 'ASIA' THEN 1 ELSE 0 END) AS nn, sum(CASE WHEN treatment <> 'ASIA' THEN 1 ELSE 0 END) AS np
  FROM samples)""", """t AS (SELECT feature_id, sum(CASE WHEN treatment = 'ASIA' THEN 1 ELSE 0 END)::BIGINT AS a,
  sum(CASE WHEN treatment <> 'ASIA' THEN 1 ELSE 0 END)::BIGINT AS b FROM pcounts JOIN samples USING (sample_id)
  WHERE abundance > 0 GROUP BY 1)""", """x AS (SELECT *, abs(a * (np - b) - b * (nn - a))::DOUBLE AS det FROM t, n)""",
    body=f"""SELECT feature_id, a AS in_neg, b AS in_pos, {rnd('''
  sqrt((nn + np) * power(greatest(det - least((nn + np) / 2, det), 0), 2)
    / nullif((a + b)::DOUBLE * (nn + np - a - b) * nn * np, 0)) * sign(a / nn - b / np)''')} AS z FROM x"""))
def e19(spark, sf):
    out = C.contaminants_prevalence(roles.part_counts(spark, sf), roles.samples(spark, sf),
                                    F.col("treatment") == "ASIA")
    return rounded(out, "z").select("feature_id", "in_neg", "in_pos", "z")


@query("e19_contaminant_scores")
def e19s(spark, sf):
    out = C.contaminants_prevalence(roles.part_counts(spark, sf), roles.samples(spark, sf),
                                    F.col("treatment") == "ASIA")
    # the threshold is the method's usual default
    return out.withColumn("contaminant", F.col("score") < 0.1)


@query("e20_clean_features", with_(PART_COUNTS, SAMPLES, TAXONOMY, body="""
SELECT * FROM pcounts WHERE feature_id IN (SELECT feature_id FROM taxonomy
  WHERE NOT regexp_matches(lineage, 'bolt') AND NOT regexp_matches(lineage, 'p__Brand#1;'))
AND feature_id NOT IN (SELECT p_partkey FROM part WHERE p_size = 7)
AND sample_id NOT IN (SELECT sample_id FROM samples WHERE treatment = 'ASIA')"""))
def e20(spark, sf):
    bad = table(spark, sf, "part").filter("p_size = 7").select(F.col("p_partkey").alias("feature_id"))
    neg = roles.samples(spark, sf).filter("treatment = 'ASIA'")
    return C.clean_features(roles.part_counts(spark, sf), roles.taxonomy(spark, sf), ["bolt", "p__Brand#1;"], bad, neg)


@query("e22_strip_replicate", """
SELECT regexp_replace(concat(l_suppkey, CASE WHEN l_returnflag = 'R' THEN '.R' ELSE '' END), '(?:\\.R)$', '') AS sample_id,
  l_partkey AS feature_id, sum(l_quantity) AS abundance FROM lineitem GROUP BY 1, 2""")
def e22(spark, sf):
    named = table(spark, sf, "lineitem").select(
        F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_returnflag") == "R", ".R").otherwise("")).alias("sample_id"),
        F.col("l_partkey").alias("feature_id"), F.col("l_quantity").alias("abundance"))
    return C.strip_replicate(named)


@query("e23_gather_to_counts", f"""
SELECT concat('q', l_suppkey) AS sample_id, concat('g', l_partkey) AS feature_id,
  {rnd('sum(l_quantity * 1000 / 1000 * l_discount)')} AS abundance FROM lineitem GROUP BY 1, 2""")
def e23(spark, sf):
    gather = table(spark, sf, "lineitem").select(
        F.concat(F.lit("q"), "l_suppkey").alias("query_name"),
        F.concat(F.lit("g"), "l_partkey", F.lit(" strain x")).alias("name"),
        (F.col("l_quantity") * 1000).alias("unique_intersect_bp"), F.lit(1000).alias("scaled"),
        F.col("l_discount").alias("average_abund"))
    return rounded(C.gather_to_counts(gather), "abundance")


@query("j10_subset_cascade", with_(PART_COUNTS, SAMPLES, TAXONOMY, """keep AS (
  SELECT * FROM pcounts WHERE sample_id IN (SELECT sample_id FROM samples WHERE treatment IN ('ASIA', 'EUROPE'))
  AND feature_id IN (SELECT feature_id FROM taxonomy WHERE lineage LIKE 'd__SMALL%'))""", body="""
SELECT 'counts' AS tbl, count(*) AS n FROM keep
UNION ALL SELECT 'samples', count(DISTINCT sample_id) FROM keep
UNION ALL SELECT 'taxonomy', count(DISTINCT feature_id) FROM keep
UNION ALL SELECT 'tree', 3 * count(DISTINCT feature_id) FROM keep"""))
def j10(spark, sf):
    tree = C.tip_closure(tree_edges(spark, sf)).withColumn("tip", F.substring("tip", 2, 20).try_cast("bigint"))
    data = C.CommunityData(roles.part_counts(spark, sf), roles.samples(spark, sf), roles.taxonomy(spark, sf), tree)
    cut = data.subset(samples=data.samples.filter(F.col("treatment").isin("ASIA", "EUROPE")),
                      features=data.taxonomy.filter(F.col("lineage").startswith("d__SMALL")))
    from fenloom.operators.tidy import stack

    tables = {"counts": cut.counts, "samples": cut.samples, "taxonomy": cut.taxonomy, "tree": cut.tree}
    return stack({k: v.agg(F.count(F.lit(1)).alias("n")) for k, v in tables.items()}, "tbl")
