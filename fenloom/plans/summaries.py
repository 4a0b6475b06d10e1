"""Grouped summaries on the driver's tables."""

from pyspark.sql import functions as F

from fenloom.operators import summary
from fenloom.plans import roles
from fenloom.plans.registry import query, rnd, with_
from fenloom.plans.roles import COUNTS, PART_COUNTS, SAMPLES, TAXONOMY, r6, rounded, table


@query("a1_mean_sd", f"""
SELECT event_type, {rnd('avg(value)')} AS mean, {rnd('stddev_samp(value)')} AS sd FROM events GROUP BY 1""")
def a1(spark, sf):
    return rounded(summary.data_summary(table(spark, sf, "events"), "value", ["event_type"]), "mean", "sd")


@query("a2_summary_se", f"""
SELECT user_id, event_type, count(v) AS n, {rnd('avg(v)')} AS mean, {rnd('stddev_samp(v)')} AS sd,
  {rnd('stddev_samp(v) / sqrt(nullif(count(v), 0))')} AS se
FROM (SELECT user_id, event_type, CASE WHEN value > 1 THEN value END AS v FROM events) GROUP BY 1, 2""")
def a2(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", F.when(F.col("value") > 1, F.col("value")).alias("v"))
    return rounded(summary.summary_se(df, "v", ["user_id", "event_type"]), "mean", "sd", "se")


@query("a3_mean_of_means", f"""
SELECT event_type, count(*) AS n, {rnd('avg(m)')} AS mean, {rnd('stddev_samp(m)')} AS sd,
  {rnd('stddev_samp(m) / sqrt(count(*))')} AS se
FROM (SELECT event_type, date_trunc('day', ts) AS d, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1""")
def a3(spark, sf):
    daily = summary.group_mean(
        table(spark, sf, "events").withColumn("d", F.date_trunc("day", "ts")), "value", ["event_type", "d"], "m")
    return rounded(summary.summary_se(daily, "m", ["event_type"]), "mean", "sd", "se")


@query("a4_a19_group_mean_error", f"""
SELECT o_orderpriority, o_orderstatus, {rnd('avg(o_totalprice)', 3)} AS mean,
  {rnd('stddev_samp(o_totalprice) / sqrt(count(*))', 3)} AS se FROM orders GROUP BY 1, 2""")
def a4(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        r6(F.avg("o_totalprice"), 3).alias("mean"), r6(summary.std_error("o_totalprice"), 3).alias("se"))


@query("a6_summary_of_totals", with_(PART_COUNTS, """tot AS (
  SELECT 'sample' AS margin, sum(abundance) AS total FROM pcounts GROUP BY sample_id
  UNION ALL SELECT 'feature', sum(abundance) FROM pcounts GROUP BY feature_id)""", body=f"""
SELECT margin, min(total) AS min, {rnd('quantile_cont(total, 0.25)')} AS q1, {rnd('quantile_cont(total, 0.5)')} AS median,
  {rnd('avg(total)')} AS mean, {rnd('quantile_cont(total, 0.75)')} AS q3, max(total) AS max FROM tot GROUP BY 1"""))
def a6(spark, sf):
    from fenloom.operators.community import feature_totals, library_size
    from fenloom.operators.tidy import stack

    c = roles.part_counts(spark, sf)
    totals = stack({"sample": library_size(c).select("total"), "feature": feature_totals(c).select("total")}, "margin")
    return rounded(summary.summary6(totals, "total", ["margin"]), "q1", "median", "mean", "q3")


@query("a7_prevalence", with_(PART_COUNTS, body="""
SELECT feature_id, count(*) AS prevalence FROM pcounts WHERE abundance > 0 GROUP BY 1"""))
def a7(spark, sf):
    from fenloom.operators.community import prevalence

    return prevalence(roles.part_counts(spark, sf))


@query("a8_taxa_per_rank", """
SELECT 'phylum' AS rank, count(DISTINCT p_brand) AS n FROM part
UNION ALL SELECT 'domain', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'class', 1 FROM part HAVING count(*) > 0
UNION ALL SELECT 'order', 1 FROM part HAVING count(*) > 0
UNION ALL SELECT 'family', 1 FROM part HAVING count(*) > 0
UNION ALL SELECT 'genus', count(DISTINCT string_split(p_name, ' ')[2]) FROM part
UNION ALL SELECT 'species', count(DISTINCT p_name) FROM part""")
def a8(spark, sf):
    from fenloom.operators.community import tax_summary

    return tax_summary(roles.taxonomy(spark, sf))


@query("a9_frequency", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a9(spark, sf):
    return summary.frequency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("a10_prob_direction", f"""
SELECT label, {rnd('avg(CAST(embedding[1] > 0 AS DOUBLE))')} AS pd FROM embeddings GROUP BY 1""")
def a10(spark, sf):
    df = table(spark, sf, "embeddings").select("label", F.get("embedding", F.lit(0)).alias("value"))
    return rounded(summary.prob_direction(df, ["label"]), "pd")


@query("a11_share_of_total", """
WITH f AS (SELECT l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1),
top AS (SELECT * FROM f ORDER BY total DESC, l_partkey LIMIT 20),
sums AS (SELECT (SELECT sum(total) FROM f) AS all_total, (SELECT sum(total) FROM top) AS top_total)
SELECT l_partkey, total, round(100 * total / top_total, 6) + 0.0::DOUBLE AS pct_of_top,
  round(100 * total / all_total, 6) + 0.0::DOUBLE AS pct_of_all FROM top, sums""")
def a11(spark, sf):
    from fenloom.operators.community import share_of_total

    f = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("total"))
    top = f.orderBy(F.desc("total"), "l_partkey").limit(20)
    return rounded(share_of_total(top, f, "total"), "pct_of_top", "pct_of_all")


@query("a12_correlation_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {rnd(f'corr({a}, {b})')} AS r FROM lineitem" for a, b in (
        ("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"),
        ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))) + ")")
def a12(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(summary.corr_matrix(table(spark, sf, "lineitem").select(*cols), cols), "r")


@query("a13_column_mean", f"SELECT {rnd('avg(n_chars)')} AS mean FROM documents")
def a13(spark, sf):
    return table(spark, sf, "documents").agg(r6(F.avg("n_chars")).alias("mean"))


BOX_SQL = f"""
WITH q AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1,
    quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT o_orderpriority, n, {rnd('q1')} AS q1, {rnd('median')} AS median, {rnd('q3')} AS q3,
  min(CASE WHEN o_totalprice BETWEEN lo AND hi THEN o_totalprice END) AS whisker_low,
  max(CASE WHEN o_totalprice BETWEEN lo AND hi THEN o_totalprice END) AS whisker_high,
  count(CASE WHEN o_totalprice NOT BETWEEN lo AND hi THEN 1 END) AS n_outliers
FROM orders JOIN f USING (o_orderpriority) GROUP BY 1, 2, 3, 4, 5"""


@query("a14_box_stats", BOX_SQL)
def a14(spark, sf):
    df = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    return rounded(summary.box_stats(df, "o_totalprice", ["o_orderpriority"]), "q1", "median", "q3")


@query("a15_histogram", """
SELECT CAST(floor(value / 2.5) AS BIGINT) AS bin, floor(value / 2.5) * 2.5 AS bin_start, count(*) AS n
FROM events GROUP BY 1, 2""")
def a15(spark, sf):
    return summary.histogram(table(spark, sf, "events"), "value", 2.5)


@query("a16_density", f"""
WITH s AS (SELECT event_type, count(*) AS n, min(value) AS mn, max(value) AS mx,
    0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34)
      * power(count(*), -0.2) AS bw FROM events GROUP BY 1),
g AS (SELECT s.*, k, mn + k * (mx - mn) / 63 AS x FROM s, (SELECT CAST(unnest(range(64)) AS INTEGER) AS k))
SELECT event_type, k, {rnd('x')} AS x, {rnd('bw')} AS bw,
  {rnd('sum(exp(-0.5 * power((x - value) / bw, 2))) / (n * bw * sqrt(2 * pi()))')} AS density
FROM g JOIN events USING (event_type) GROUP BY event_type, k, x, bw, n""")
def a16(spark, sf):
    df = table(spark, sf, "events").select("event_type", "value")
    return rounded(summary.kde_grid(df, "value", ["event_type"]), "x", "bw", "density")


@query("a17_add_count", """
SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n,
  count(*) OVER (PARTITION BY l_returnflag) AS n_flag FROM lineitem""")
def a17(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    out = summary.add_count(summary.add_count(df, ["l_suppkey", "l_returnflag"]), ["l_returnflag"], "n_flag")
    return out.select("l_orderkey", "l_linenumber", "n", "n_flag")


@query("a18_fitted_line", f"""
SELECT l_returnflag, {rnd('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope,
  {rnd('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept,
  {rnd('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem GROUP BY 1""")
def a18(spark, sf):
    out = summary.lm_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(out, "slope", "intercept", digits=4), "r2")
