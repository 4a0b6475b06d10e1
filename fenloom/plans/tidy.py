"""Filters, joins, sets, reshapes, scalar functions and sorts on the driver's tables."""

from pyspark.sql import Window, functions as F

from fenloom.functions import scalar as X
from fenloom.operators import summary, tidy
from fenloom.plans import roles
from fenloom.plans.registry import query, rnd, with_
from fenloom.plans.roles import COUNTS, PART_COUNTS, SAMPLES, TAXONOMY, r6, rounded, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENTS = ["click", "error", "purchase", "signup", "view"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# ---- filters and projections -------------------------------------------------------


@query("f1_exclude_levels", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') AND o_orderstatus IN ('O', 'F')""")
def f1(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return df.filter(
        ~F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED") & F.col("o_orderstatus").isin("O", "F")
    ).drop("o_orderstatus")


@query("f2_negated_conjunction", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity FROM lineitem
WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O') AND NOT (l_returnflag = 'A' AND l_quantity > 10)""")
def f2(spark, sf):
    a = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    b = (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 10)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"
    ).filter(~a & ~b)


@query("f3_threshold", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500 AND abs(n_chars - 3000) > 1000")
def f3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").filter(
        (F.col("n_chars") >= 500) & (F.abs(F.col("n_chars") - 3000) > 1000)
    )


@query("f4_level_subset", """
SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND user_id <> 3""")
def f4(spark, sf):
    return table(spark, sf, "events").filter(
        (F.col("event_type") == "purchase") & (F.col("user_id") != 3)
    ).select("event_id", "user_id", "value")


@query("f5_regex_filter", """
SELECT p_partkey, p_name FROM part
WHERE regexp_matches(p_name, '(?i)BOLT|gear') AND NOT regexp_matches(p_name, 'Red|^small')""")
def f5(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    df = tidy.grep_filter(df, "p_name", "BOLT|gear", ignore_case=True)
    return tidy.grep_filter(df, "p_name", "Red|^small", invert=True)


@query("f6_select_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem""")
def f6(spark, sf):
    df = tidy.select_matching(table(spark, sf, "lineitem"), r"date|flag|status|price", invert=True)
    return tidy.drop_positions(df, 3)


@query("f7_drop_nulls", """
SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
  nullif(o_orderpriority, '5-LOW') AS priority FROM orders)
WHERE status IS NOT NULL AND priority IS NOT NULL""")
def f7(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )
    return df.dropna(subset=["status", "priority"])


@query("f8_clamp", """
SELECT vec_id, CASE WHEN a < 0 THEN 0 ELSE a END AS e0, CASE WHEN b < 0 THEN 0 ELSE b END AS e1
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)""")
def f8(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in (0, 1)]
    )
    return tidy.clamp(df, ["e0", "e1"])


@query("f10_f11_derived_columns", f"""
SELECT l_orderkey, l_linenumber, {rnd('l_extendedprice * (1 - l_discount) / 100')} AS net,
  {rnd('l_quantity + 0.1', 4)} AS l_quantity FROM lineitem""")
def f10(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        r6(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100).alias("net"), "l_quantity",
    )
    return rounded(tidy.offset(df, ["l_quantity"], 0.1), "l_quantity", digits=4)


@query("f12_rename", "SELECT s_suppkey AS sample_id, s_name AS name, s_acctbal AS balance FROM supplier")
def f12(spark, sf):
    return table(spark, sf, "supplier").withColumnsRenamed(
        {"s_suppkey": "sample_id", "s_name": "name", "s_acctbal": "balance"}
    ).select("sample_id", "name", "balance")


@query("f13_conditional_recode", """
SELECT event_id, CASE WHEN value > 50 AND event_type = 'purchase' THEN 'up'
  WHEN value < 5 THEN 'down' WHEN event_type = 'error' THEN 'err' END AS status FROM events""")
def f13(spark, sf):
    status = X.case_when(
        ((F.col("value") > 50) & (F.col("event_type") == "purchase"), "up"),
        (F.col("value") < 5, "down"), (F.col("event_type") == "error", "err"),
    )
    return table(spark, sf, "events").select("event_id", status.alias("status"))


@query("f14_masked_update", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN event_type <> 'error' THEN user_id END AS user_id FROM events""")
def f14(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    return tidy.mask(df, F.col("event_type") == "error", ["value", "user_id"]).drop("event_type")


@query("f15_one_hot", "SELECT event_id, " + ", ".join(
    f"CAST(event_type = '{e}' AS INTEGER) AS is_{e}" for e in EVENTS) + " FROM events")
def f15(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return tidy.one_hot(df, "event_type", EVENTS).drop("event_type")


@query("f16_split_complete", """
SELECT CASE WHEN status IS NOT NULL AND priority IS NOT NULL THEN 'kept' ELSE 'rejected' END AS part,
  count(*) AS n, sum(o_orderkey)::BIGINT AS keys
FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority
  FROM orders) GROUP BY 1""")
def f16(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )
    kept, rejected = tidy.split_complete(df, ["status", "priority"])
    return tidy.stack({"kept": kept, "rejected": rejected}, "part").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
    )


@query("f17_flag_filter", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS flag FROM lineitem
WHERE (CAST(l_quantity AS INTEGER) & 4) = 0""")
def f17(spark, sf):
    return tidy.mapped(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("flag")))


# ---- joins -------------------------------------------------------------------------


@query("j1_inner_join", f"""
SELECT o_orderpriority, c_mktsegment, count(*) AS n, {rnd('sum(o_totalprice)', 2)} AS total
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def j1(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_orderpriority", "c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice"), 2).alias("total"))
    )


@query("j2_left_join", """
SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def j2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")


@query("j3_anti_join", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(
        table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j4_semi_join", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def j4(spark, sf):
    big = table(spark, sf, "orders").filter(F.col("o_totalprice") > 400000).select(
        F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(big, "c_custkey", "left_semi")


@query("j5_filter_by_ids", """
SELECT doc_id, length(text) AS seq_length FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def j5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("seq_length"))
    return tidy.filter_by_ids(docs, table(spark, sf, "labels").filter("quality = 1"), "doc_id")


@query("j6_order_like", """
SELECT s_suppkey, s_name, pos FROM supplier JOIN (
  SELECT l_suppkey AS s_suppkey, sum(l_quantity) AS pos FROM lineitem GROUP BY 1) USING (s_suppkey)
ORDER BY pos""")
def j6(spark, sf):
    pos = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.sum("l_quantity").alias("pos"))
    return tidy.order_like(table(spark, sf, "supplier").select("s_suppkey", "s_name"), pos, "s_suppkey", "pos")


@query("j7_compare_groups", "WITH a AS (SELECT user_id, event_type, avg(value) AS mean, count(*) AS n "
       "FROM events GROUP BY 1, 2) SELECT user_id, " + ", ".join(
           f"{rnd(f'max(CASE WHEN event_type = {e!r} THEN mean END)')} AS {e}_mean, "
           f"max(CASE WHEN event_type = '{e}' THEN n END) AS {e}_n" for e in ("click", "view"))
       + " FROM a GROUP BY 1")
def j7(spark, sf):
    agg = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    out = tidy.compare_groups(agg, ["user_id"], "event_type", ["click", "view"], ["mean", "n"])
    return rounded(out, "click_mean", "view_mean")


@query("j8_remap_ids", """
WITH m AS (SELECT DISTINCT p_partkey, concat('ASV', row_number() OVER (ORDER BY md5(p_partkey::VARCHAR))) AS new_id
  FROM part)
SELECT new_id AS l_partkey, count(*) AS n, sum(l_quantity) AS qty
FROM lineitem JOIN m ON p_partkey = l_partkey GROUP BY 1""")
def j8(spark, sf):
    mapping = tidy.ordinal_ids(table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey",
                               "ASV")
    counts = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    return tidy.remap_ids(counts, mapping, "l_partkey", "new_id")


@query("j9_regroup", with_(PART_COUNTS, """map AS (
  SELECT p_partkey AS feature_id, p_brand AS group_id FROM part WHERE p_type <> 'PROMO'
  UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size > 25 AND p_type <> 'PROMO')""", body="""
SELECT sample_id, coalesce(group_id, 'UNGROUPED') AS group_id, sum(abundance) AS abundance
FROM pcounts LEFT JOIN map USING (feature_id) GROUP BY 1, 2"""))
def j9(spark, sf):
    part = table(spark, sf, "part").filter("p_type <> 'PROMO'")
    mapping = part.select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("group_id")).unionByName(
        part.filter("p_size > 25").select(F.col("p_partkey").alias("feature_id"), F.col("p_type").alias("group_id")))
    return tidy.regroup(roles.part_counts(spark, sf), mapping)


# ---- sets --------------------------------------------------------------------------


@query("u1_labelled_union", """
SELECT 'supplier' AS source, s_nationkey AS nationkey, count(*) AS n FROM supplier GROUP BY 2
UNION ALL SELECT 'customer', c_nationkey, count(*) FROM customer GROUP BY 2""")
def u1(spark, sf):
    s = summary.frequency(table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nationkey"), "nationkey")
    c = summary.frequency(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nationkey"), "nationkey")
    return tidy.stack({"supplier": s, "customer": c}, "source")


@query("u2_distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def u2(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("u3_distinct_keys", """
SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 450000
  UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def u3(spark, sf):
    a = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("k"))
    return tidy.distinct_keys([a, b], "k")


@query("u4_with_metadata", with_(PART_COUNTS, SAMPLES, body="""
SELECT sample_id, total, treatment, block, depth FROM
  (SELECT sample_id, sum(abundance) AS total FROM pcounts GROUP BY 1) JOIN samples USING (sample_id)"""))
def u4(spark, sf):
    scores = roles.part_counts(spark, sf).groupBy("sample_id").agg(F.sum("abundance").alias("total"))
    return tidy.with_metadata(scores, roles.samples(spark, sf))


# ---- reshapes ----------------------------------------------------------------------


@query("r1_to_long", """
UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value""")
def r1(spark, sf):
    df = table(spark, sf, "lineitem")
    return tidy.to_long(df, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("r2_to_wide", "SELECT o_custkey, " + ", ".join(
    f"coalesce(sum(CASE WHEN o_orderpriority = '{p}' THEN 1 END), 0)::BIGINT AS \"{p}\"" for p in PRIORITIES)
    + " FROM orders GROUP BY 1")
def r2(spark, sf):
    per = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.lit(1).cast("bigint").alias("n"))
    return tidy.to_wide(per, ["o_custkey"], "o_orderpriority", "n", PRIORITIES)


@query("r3_transpose_long", with_(COUNTS, SAMPLES, body="""
SELECT feature_id AS row_id, treatment AS col_id, sum(abundance) AS value
FROM counts JOIN samples USING (sample_id) GROUP BY 1, 2"""))
def r3(spark, sf):
    # in long form a transpose is a change of roles: rows become columns
    long = roles.counts(spark, sf).join(roles.samples(spark, sf), "sample_id").groupBy(
        "feature_id", "treatment").agg(F.sum("abundance").alias("value"))
    return long.withColumnsRenamed({"feature_id": "row_id", "treatment": "col_id"})


@query("r4_separate", """
SELECT p_partkey, string_split(p_name, ' ')[1] AS colour, string_split(p_name, ' ')[2] AS thing,
  string_split(p_name, ' ')[3] AS extra FROM part""")
def r4(spark, sf):
    return tidy.separate(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name",
                         ["colour", "thing", "extra"], " ")


@query("r5_unite", "SELECT p_partkey, concat_ws('.', p_type, p_brand, p_size) AS key FROM part")
def r5(spark, sf):
    return tidy.unite(table(spark, sf, "part"), "key", ["p_type", "p_brand", "p_size"], ".").select("p_partkey", "key")


@query("r6_split_at", """
SELECT page_id, array_to_string(p[1:3], '/') AS head, array_to_string(p[4:], '/') AS tail
FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)""")
def r6q(spark, sf):
    head, tail = X.split_at("url", "/", 3)
    return table(spark, sf, "pages").select("page_id", head.alias("head"), tail.alias("tail"))


# ---- scalar functions -----------------------------------------------------------------


@query("x1_x3_x4_text", r"""
SELECT p_partkey, regexp_replace(p_name, '(?: bolt| gear)$', '') AS stripped,
  string_split(p_name, ' ')[1] AS word, concat_ws('-', p_brand, p_name) AS pasted,
  regexp_matches(p_name, '(?i)RED') AS is_red FROM part""")
def x1(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", X.strip_suffix("p_name", " bolt| gear").alias("stripped"),
        X.first_word("p_name").alias("word"), X.paste("p_brand", "p_name", sep="-").alias("pasted"),
        X.detect("p_name", "RED", ignore_case=True).alias("is_red"))


@query("x5_wrap_text", r"""
SELECT item_id, regexp_replace(replace(text, chr(10), ' '), '(.{1,20})( +|$)', '\1' || chr(10), 'g') AS wrapped
FROM benchmark""")
def x5(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", X.wrap(F.regexp_replace("text", "\n", " "), 20).alias("wrapped"))


@query("x6_round_half_even", """
SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half FROM lineitem""")
def x6(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", X.round_even(F.col("l_quantity") / 2).alias("half"))


@query("x7_x8_math", f"""
SELECT event_id, {rnd('ln(value + 1)')} AS ln1, {rnd('log2(value + 0.5)')} AS l2, {rnd('sqrt(value)')} AS root,
  {rnd('abs(value - 20)')} AS dev, {rnd('exp(value / 100) * exp(0.5) * 1000', 3)} AS back FROM events""")
def x7(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", r6(F.log(v + 1)).alias("ln1"), r6(F.log2(v + 0.5)).alias("l2"), r6(F.sqrt(v)).alias("root"),
        r6(F.abs(v - 20)).alias("dev"),
        r6(X.back_transform(v / 100, F.lit(0.5), 1000), 3).alias("back"))


@query("x9_label_null", """
SELECT doc_id, coalesce(nullif(lang, 'en'), 'Unknown') AS lang FROM documents""")
def x9(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.label_null(F.nullif("lang", F.lit("en")), "Unknown").alias("lang"))


@query("x10_casts", r"""
SELECT event_id, TRY_CAST(regexp_extract(props, ': *([0-9]+)', 1) AS BIGINT) AS k,
  CAST(value AS BIGINT) AS v_int, TRY_CAST(event_type AS INTEGER) AS bad FROM
  (SELECT event_id, props, event_type, trunc(value) AS value FROM events)""")
def x10(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.regexp_extract("props", ": *([0-9]+)", 1).alias("k"), F.col("value").alias("v_int"),
        F.col("event_type").alias("bad"))
    return X.cast_schema(df, {"k": "bigint", "v_int": "bigint", "bad": "int"})


@query("x11_parse_lineage", with_(TAXONOMY, body="SELECT feature_id, " + ", ".join(
    f"nullif(regexp_replace(trim(string_split(lineage, ';')[{i + 1}]), '^[a-z]__', ''), '') AS {r}"
    for i, r in enumerate(("domain", "phylum", '"class"', '"order"', "family", "genus", "species"))) + " FROM taxonomy"))
def x11(spark, sf):
    return roles.taxonomy(spark, sf).select("feature_id", *X.parse_lineage("lineage"))


@query("x12_clean_text", r"""
SELECT item_id, replace(replace(replace(text, chr(10), chr(13) || chr(9)), chr(13), ''), chr(9), ',') AS cleaned
FROM benchmark""")
def x12(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", X.clean_text(F.regexp_replace("text", "\n", "\r\t")).alias("cleaned"))


@query("x13_rate", f"""
SELECT l_orderkey, l_linenumber, {rnd('(l_extendedprice - l_quantity) / 24')} AS rate FROM lineitem""")
def x13(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(X.rate("l_extendedprice", "l_quantity", 24)).alias("rate"))


@query("x14_recode", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 22
  WHEN '5-LOW' THEN 55 END AS day FROM orders""")
def x14(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", X.recode("o_orderpriority", {"1-URGENT": 1, "3-MEDIUM": 22, "5-LOW": 55}).alias("day"))


# ---- order, top-n, windows ---------------------------------------------------------------


@query("o1_sort_by_levels", """
SELECT o_orderkey, o_orderpriority, o_totalprice,
  CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 END::BIGINT AS ord
FROM orders ORDER BY ord NULLS LAST, o_totalprice DESC, o_orderkey""")
def o1(spark, sf):
    levels = ["5-LOW", "1-URGENT", "3-MEDIUM"]
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    df = tidy.arrange(df, "o_orderpriority", "-o_totalprice", "o_orderkey", levels={"o_orderpriority": levels})
    return df.withColumn("ord", tidy.level_position("o_orderpriority", levels))


@query("o5_reorder_levels", """
SELECT l_returnflag, row_number() OVER (ORDER BY avg(l_quantity), l_returnflag) AS ord
FROM lineitem GROUP BY 1""")
def o5(spark, sf):
    mean = summary.group_mean(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])
    # one row per level
    return tidy.with_order(mean, [F.col("mean"), F.col("l_returnflag")], out="ord").select(
        "l_returnflag", F.col("ord").cast("bigint").alias("ord"))


@query("o6_order_samples", with_(SAMPLES, body="""
SELECT sample_id, treatment, row_number() OVER (
  ORDER BY CASE treatment WHEN 'ASIA' THEN 1 WHEN 'AFRICA' THEN 2 WHEN 'EUROPE' THEN 3 WHEN 'AMERICA' THEN 4
  ELSE 5 END, sample_id) AS pos FROM samples"""))
def o6(spark, sf):
    levels = ["ASIA", "AFRICA", "EUROPE", "AMERICA", "MIDDLE EAST"]
    df = roles.samples(spark, sf).select("sample_id", "treatment").withColumn(
        "_lv", tidy.level_position("treatment", levels))
    # rows before a level come from level totals; the inner order is per level
    start = Window.orderBy("_lv").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("_lv").agg(F.count(F.lit(1)).alias("_n")).select(
        "_lv", F.coalesce(F.sum("_n").over(start), F.lit(0)).alias("_s"))
    inner = F.row_number().over(Window.partitionBy("_lv").orderBy("sample_id"))
    return df.withColumn("_r", inner).join(starts, "_lv").select(
        "sample_id", "treatment", (F.col("_s") + F.col("_r")).alias("pos"))


@query("o7_sort_alignments", """
SELECT l_suppkey AS ref, l_orderkey AS pos, l_linenumber FROM lineitem ORDER BY ref, pos""")
def o7(spark, sf):
    from fenloom.operators.reads import sort_alignments

    aln = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("ref"), F.col("l_orderkey").alias("pos"), "l_linenumber")
    return sort_alignments(aln, "ref", "pos")


@query("o8_keep_params", """
SELECT event_type AS parameter, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1""")
def o8(spark, sf):
    t = summary.frequency(table(spark, sf, "events").withColumnRenamed("event_type", "parameter"), "parameter")
    return tidy.keep_params(t, ["click", "error"])


@query("w1_keep_max", """
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) = 1""")
def w1(spark, sf):
    df = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return tidy.keep_max(df, ["l_partkey"], "l_quantity")


@query("w2_group_mean_rows", f"""
SELECT DISTINCT l_partkey, l_returnflag, {rnd('avg(l_quantity) OVER (PARTITION BY l_partkey, l_returnflag)')}
  AS group_mean FROM lineitem""")
def w2(spark, sf):
    df = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    out = summary.attach_group_mean(df, "l_quantity", ["l_partkey", "l_returnflag"])
    return rounded(out.drop("l_quantity"), "group_mean").distinct()


@query("w3_w4_top_n_numbered", with_(COUNTS, """tot AS (
  SELECT p_type, p_brand, sum(l_quantity) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)""",
    """top AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY total DESC) AS r FROM tot QUALIFY r <= 5)""",
    body="""SELECT p_type, p_brand, total, -row_number() OVER (ORDER BY p_type, total, p_brand) AS "order"
FROM top"""))
def w3(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    tot = table(spark, sf, "lineitem").select("l_partkey", "l_quantity").join(part, "l_partkey").groupBy(
        "p_type", "p_brand").agg(F.sum("l_quantity").alias("total"))
    top = tidy.top_n(tot, 5, ["p_type"], "total")
    out = tidy.with_order(top, [F.col("p_type"), F.col("total"), F.col("p_brand")], negative=True)
    return out.withColumn("order", F.col("order").cast("bigint"))


@query("w5_forward_fill", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN substr(text, 1, 10) END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations""")
def w5(spark, sf):
    from fenloom.operators.ordering import forward_fill

    df = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.substring("text", 1, 10)).alias("heading"))
    return forward_fill(df, ["heading"], ["conv_id"], "turn")


@query("w6_standardise", f"""
SELECT event_id, {rnd('(value - avg(value) OVER ()) / stddev_samp(value) OVER ()')} AS value FROM events""")
def w6(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return rounded(summary.standardise(df, ["value"]), "value")


@query("w8_average_rank", """
SELECT event_type, event_id, rank() OVER (PARTITION BY event_type ORDER BY value)
  + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rank FROM events""")
def w8(spark, sf):
    from fenloom.operators.ordering import average_rank

    df = table(spark, sf, "events").select("event_type", "event_id", "value")
    return average_rank(df, "value", ["event_type"]).select("event_type", "event_id", "rank")
