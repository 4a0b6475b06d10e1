"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

As a stage reads what its predecessor wrote, the predecessor's own scratch tables are not needed
any more when it is called, and it drops them: a stage's result is to be written, or counted,
before the next stage is called.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import time
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fenloom.llm import exact, langid, mixing, near, pieces
from fenloom.llm.common import chunked
from fenloom.session import drop_scratch, scratch_group, scratch_path, shared_dir


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    time.sleep(0.2)  # so that the tasks of a wave run side by side, each in a worker of its own


def return_memory(spark: SparkSession) -> None:
    """Python workers keep the memory of their largest task; a wave of empty tasks has them return it.

    It changes no result, and a stage runs without it as well, only beside fuller workers.
    """
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, 2 * slots, 1, 2 * slots).mapInArrow(_returned, "id long").count()


_scratch: dict[str, list[str]] = {}  # by shared folder


def stage(work):
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _scratch.setdefault(shared_dir(spark), [])
        while left:
            drop_scratch(spark, left.pop())
        with scratch_group(spark, work.__name__) as folder:
            left.append(folder)
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the classifier learns from rows that are not held out."""
    model = langid.fit(docs)
    found = langid.predict(docs, model).filter("accepted")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text one stays."""
    return exact.ExactDedup(docs).kept()


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one stays."""
    return_memory(spark)
    kept = near.NearDuplicates(docs, keep_rows=True).kept()
    return_memory(spark)  # here, as the next stage is to run no Python
    return kept


@stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: repeated, left out, or cut at the edges of blocks."""
    spool = chunked(mixing.sized(docs, "doc_id", "source", "text"), docs.rdd.getNumPartitions(), "sizes")
    taken = mixing.Mix(spool.drop("row", "chunk")).take(spool, "text", docs.columns)
    return taken.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else taken


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document under merge-dropout, and whether they decode to its text."""
    return_memory(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.encode_documents(docs, path, check=True)
    return rows.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("language", known_language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixed_sources),
    ("pieces", encoded),
]

#: The stages train a model and hash, which SQL cannot state; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, work) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_scratch(spark, before)
        before = path
    return docs
