"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fenloom.llm import collocations, exact, html, langid, licenses, mixing, near, packing, pieces, quality, resampling, tokenfiles, vectors
from fenloom.llm.common import held_out
from fenloom.session import cut_lineage, scratch_path

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.ExactDedup(docs).report().withColumnRenamed("id", "doc_id")


@query("op2_mixing", mixing.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = cut_lineage(mixing.sized(docs, "doc_id", "source", "text").drop("row"), "sizes")
    return mixing.Mix(sizes).rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out(F.col("row.doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "accepted")


@query("op6_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.NearDuplicates(docs).report().withColumnRenamed("id", "doc_id")


@query("op7_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids under dropout, and whether decoding them gives the text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_documents(docs, path)
    text = F.coalesce("row.text", F.lit(""))
    return coded.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        F.length(text).cast("long").alias("n_chars"), (pieces.text_from(F.col("ids"), path) == text).alias("lossless"))


@query("op5_license_scan", licenses.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("spans").withColumnRenamed("id", "doc_id")


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenfiles.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return tokenfiles.read(spark, folder)


@query("op10_near_vectors")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "row.doc_id", held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "score", "predicted")


@query("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op11_collocations", collocations.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))
    return collocations.top(kept).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op12_importance_resampling", resampling.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = resampling.resample(docs, target, lo=1, hi=1, buckets=10_000, seed=2024, min_words=20, percent=10)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.Packing(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end=0)
    return packed.placed().withColumnRenamed("id", "doc_id")
