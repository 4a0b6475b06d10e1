"""Sequence files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

FILE_NAME = r"([^/]+)$"
STEM = r"([^/]+?)(?:\.[^./]*)?$"


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(path, file, read_id, description, seq).  Records are split at line-start '>' by the text
    reader itself, so one large file is read by many tasks."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    body = F.regexp_replace("value", r"^\ufeff?>", "")
    head = F.regexp_replace(F.substring_index(body, "\n", 1), "\r", "")
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*", ""), r"\s", "")
    return raw.filter(F.trim("value") != "").select("path", head.alias("header"), seq.alias("seq")).select(
        "path", F.regexp_extract("path", FILE_NAME, 1).alias("file"), clean_id("header").alias("read_id"),
        F.col("header").alias("description"), "seq")


def clean_id(col: str = "read_id"):
    """Id up to the first blank."""
    return F.substring_index(F.col(col), " ", 1)


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(path, file, line_no, line) with line numbers from 0, without reading a file in one task.

    Lines are numbered within each file split; a split starts from the line counts of the
    splits before it, of which there is one row each. Files are told apart by their full path.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_s"),
        F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line"))
    from fenloom.session import cut_lineage

    raw = cut_lineage(raw)
    before = Window.partitionBy("path").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("path", "_s").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n")).select(
        "path", "_s", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return raw.join(splits, ["path", "_s"]).select(
        "path", F.regexp_extract("path", FILE_NAME, 1).alias("file"),
        (F.col("_base") + F.col("_m") - F.col("_first")).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """(path, file, read_id, seq, qual) from four-line records.

    A quality line may start with '@', so records are framed by line number.
    """
    lines = numbered_lines(spark, path)
    part = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("line")))
    rec = lines.groupBy("path", "file", F.floor(F.col("line_no") / 4).alias("rec")).agg(
        part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    return rec.filter(F.col("head").startswith("@")).select(
        "path", "file", F.substring_index(F.regexp_replace("head", "^@", ""), " ", 1).alias("read_id"), "seq", "qual")


def seq_lengths(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", F.length("seq").alias("length"))


def tag_source(reads: DataFrame, pattern: str = STEM) -> DataFrame:
    """Append what ``pattern`` takes from the source file's path, by default its stem, to each id."""
    return reads.withColumn("read_id", F.concat_ws("_", "read_id", F.regexp_extract("path", pattern, 1)))


def contigs_to_bin(spark: SparkSession, glob: str, binner: str, pattern: str = STEM) -> DataFrame:
    """(contig, bin, binner): each record with the bin that ``pattern`` takes from its file's path.

    A bin may be spread over the files of one folder; two folders that give one bin name are an error.
    """
    bin_of = F.regexp_extract("path", pattern, 1)
    files = spark.createDataFrame([(f,) for f in spark.read.text(glob).inputFiles()], "path string")
    clash = files.select(bin_of.alias("bin"), F.regexp_extract("path", r"^(.*)/", 1).alias("folder")).distinct().groupBy(
        "bin").count().filter("count > 1").select("bin").head()
    if clash:
        raise ValueError(f"bin {clash[0]} is named by files of two folders; give a pattern over the path")
    return read_fasta(spark, glob).select(F.col("read_id").alias("contig"), bin_of.alias("bin"), F.lit(binner).alias("binner"))
