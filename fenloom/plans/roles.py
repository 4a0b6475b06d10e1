"""The driver's tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ---- SQL fragments ---------------------------------------------------------------

COUNTS = """counts AS (
  SELECT l_suppkey AS sample_id, p_name AS feature_id, sum(l_quantity) AS abundance
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""

PART_COUNTS = """pcounts AS (
  SELECT l_suppkey AS sample_id, l_partkey AS feature_id, sum(l_quantity) AS abundance
  FROM lineitem GROUP BY 1, 2)"""

SAMPLES = """samples AS (
  SELECT s_suppkey AS sample_id, r_name AS treatment, n_name AS block, s_acctbal AS depth
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""

TAXONOMY = """taxonomy AS (
  SELECT p_partkey AS feature_id,
         concat('d__', p_type, ';p__', p_brand, ';c__;o__;f__;g__',
                string_split(p_name, ' ')[2], ';s__', p_name) AS lineage
  FROM part)"""

DRAW_SEED = 1115


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(col, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in cols})


# ---- Spark -----------------------------------------------------------------------

def counts(spark, sf) -> DataFrame:
    """(sample_id, feature_id, abundance): quantity per supplier and part name."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_name").alias("feature_id"))
        .agg(F.sum("l_quantity").alias("abundance"))
    )


def part_counts(spark, sf) -> DataFrame:
    """The sparser table: quantity per supplier and part key."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature_id"))
        .agg(F.sum("l_quantity").alias("abundance"))
    )


def samples(spark, sf) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, F.col("n_nationkey") == F.col("s_nationkey"))
        .join(r, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            F.col("s_suppkey").alias("sample_id"), F.col("r_name").alias("treatment"),
            F.col("n_name").alias("block"), F.col("s_acctbal").alias("depth"),
        )
    )


def taxonomy(spark, sf) -> DataFrame:
    """(feature_id, lineage) for part keys; three ranks are blank, as in real files."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("feature_id"),
        F.concat(
            F.lit("d__"), "p_type", F.lit(";p__"), "p_brand", F.lit(";c__;o__;f__;g__"),
            F.get(F.split("p_name", " "), F.lit(1)), F.lit(";s__"), "p_name",
        ).alias("lineage"),
    )
