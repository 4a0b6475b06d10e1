"""Reads, contigs, alignments and hit tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType

from fenloom.functions.scalar import kmers
from fenloom.operators.ordering import next_value, running_total
from fenloom.operators.summary import frequency
from fenloom.operators.tidy import keep_max
from fenloom.session import cut_lineage, spread

PIECE = 10_000  # characters of a contig piece
WORD_PIECE = 500  # characters whose k-mers are listed as one array


# ---- reads ---------------------------------------------------------------------------------


def demux(reads: DataFrame, barcodes: DataFrame, sheet: DataFrame, unmatched: str = "unmatched") -> DataFrame:
    """Give each read its sample by exact barcode; the rest are labelled, not dropped."""
    return (
        reads.join(barcodes.select("read_id", "barcode"), "read_id", "left")
        .join(sheet.select("barcode", "sample_id"), "barcode", "left")
        .withColumn("sample_id", F.coalesce(F.col("sample_id").cast("string"), F.lit(unmatched)))
        .drop("barcode")
    )


def demux_summary(reads: DataFrame) -> DataFrame:
    return frequency(reads, "sample_id")


def _score_counts(by: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, quals in pdf.groupby(by, sort=False, dropna=False)["qual"]:
                texts = [q.encode("latin-1") for q in quals if q]
                if not texts:
                    continue
                sizes = np.array([len(t) for t in texts])
                score = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) - 33
                pos = np.arange(len(score)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                cell, n = np.unique(pos * 256 + score + 33, return_counts=True)
                yield pd.DataFrame({by: name, "pos": cell // 256 + 1, "score": cell % 256 - 33, "n": n})

    return run


def quality_profile(reads: DataFrame, by: str = "file") -> DataFrame:
    """Mean and quartiles of quality at each position.

    Scores take few values, so each batch of reads is turned into (file, position, score)
    counts where it lies, and only those are shuffled.
    """
    t = reads.schema[by].dataType.simpleString()
    part = reads.select(by, "qual").mapInPandas(_score_counts(by), f"{by} {t}, pos int, score int, n bigint")
    cells = part.groupBy(by, "pos", "score").agg(F.sum("n").alias("n"))
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return cells.groupBy(by, "pos").agg(
        F.sum("n").alias("n"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"), q.alias("q")
    ).select(by, "pos", "n", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def quality_cut(profile: DataFrame, by: str = "file", threshold: float = 20) -> DataFrame:
    """First position whose mean quality is below the threshold."""
    return profile.filter(F.col("mean") < threshold).groupBy(by).agg(F.min("pos").alias("cut"))


def truncate(reads: DataFrame, length: int) -> DataFrame:
    """Cut reads to a fixed length; shorter ones are dropped."""
    return reads.filter(F.length("seq") >= length).withColumns(
        {c: F.substring(c, 1, length) for c in ("seq", "qual") if c in reads.columns})


def trimmed_length(window: int = 4, quality: float = 20):
    """Column function: bases kept before the first window whose mean quality is too low."""

    @F.pandas_udf(IntegerType())
    def kept(qual: pd.Series) -> pd.Series:
        out = np.zeros(len(qual), dtype=np.int32)
        for r, text in enumerate(qual):
            n = len(text) if text else 0
            if n < window:
                continue
            total = np.cumsum(np.frombuffer(text.encode("latin-1"), dtype=np.uint8).astype(np.int64) - 33)
            sums = total[window - 1:] - np.concatenate(([0], total[:-window]))
            low = np.flatnonzero(sums < quality * window)
            out[r] = low[0] if len(low) else n
        return pd.Series(out)

    return kept


def sliding_trim(reads: DataFrame, window: int = 4, quality: float = 20, min_length: int = 25) -> DataFrame:
    return (
        reads.withColumn("_k", trimmed_length(window, quality)("qual")).filter(F.col("_k") >= min_length)
        .withColumn("seq", F.expr("substring(seq, 1, _k)")).withColumn("qual", F.expr("substring(qual, 1, _k)")).drop("_k")
    )


def sliding_trim_paired(forward: DataFrame, reverse: DataFrame, window: int = 4, quality: float = 20,
                        min_length: int = 25) -> DataFrame:
    """Trim both mates; each survivor is routed to 1P/2P when its mate survives, else 1U/2U."""
    f = sliding_trim(forward, window, quality, min_length).select(
        "read_id", F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    r = sliding_trim(reverse, window, quality, min_length).select(
        "read_id", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    both = f.join(r, "read_id", "full")
    has1, has2 = F.col("seq1").isNotNull(), F.col("seq2").isNotNull()
    mates = F.array(
        F.when(has1, F.struct(F.when(has2, "1P").otherwise("1U").alias("output"), F.col("seq1").alias("seq"), F.col("qual1").alias("qual"))),
        F.when(has2, F.struct(F.when(has1, "2P").otherwise("2U").alias("output"), F.col("seq2").alias("seq"), F.col("qual2").alias("qual"))))
    return both.select("read_id", F.explode(F.array_compact(mates)).alias("m")).select("read_id", "m.*")


def dereplicate(reads: DataFrame) -> DataFrame:
    """Exact sequences as features: only the digest of a sequence is shuffled."""
    return reads.groupBy("sample_id", F.md5("seq").alias("feature_id")).agg(F.count(F.lit(1)).alias("abundance"))


def representative_sequences(reads: DataFrame) -> DataFrame:
    """(feature_id, seq): the sequence behind each digest of :func:`dereplicate`."""
    return reads.groupBy(F.md5("seq").alias("feature_id")).agg(F.first("seq").alias("seq"))


def kmer_pieces(df: DataFrame, text: str, k: int) -> DataFrame:
    """The whole text in pieces that overlap by k - 1: no array grows with a text and no k-mer is lost.

    Pieces, not texts, are spread over the tasks, so one giant sequence is shared out.  (Taking
    a substring walks the text up to it, hence two sizes of piece.)
    """
    keep = [c for c in df.columns if c != text]

    def cut(rows: DataFrame, size: int) -> DataFrame:
        n = F.length(text)
        at = F.explode(F.sequence(F.lit(0), F.floor((n - k) / F.lit(size)).cast("int"))).alias("_p")
        return rows.filter(n >= k).select(*keep, text, at).select(
            *keep, F.substring(F.col(text), F.col("_p") * size + 1, F.lit(size + k - 1)).alias(text))

    # spread by place too: equal pieces, as in runs of one letter, must not meet in one task
    pieces = cut(cut(df, PIECE * 10), WORD_PIECE).withColumn("_at", F.monotonically_increasing_id())
    return spread(pieces, "_at").drop("_at")


def kmer_rows(df: DataFrame, text: str, k: int, out: str = "kmer") -> DataFrame:
    """One row per overlapping k-mer of the whole text."""
    keep = [c for c in df.columns if c != text]
    return kmer_pieces(df, text, k).select(*keep, F.explode(kmers(text, k)).alias(out))


def train_classifier(seqs: DataFrame, label: str, k: int) -> tuple[DataFrame, DataFrame]:
    """k-mer counts per class, and class sizes, of a multinomial naive Bayes model."""
    words = kmer_rows(seqs.select(label, "seq"), "seq", k).groupBy(label, "kmer").agg(F.count(F.lit(1)).alias("c"))
    docs = seqs.groupBy(label).agg(F.count(F.lit(1)).alias("docs"))
    words = cut_lineage(words.withColumnRenamed(label, "label"))
    vocabulary = words.agg(F.count_distinct("kmer")).scalar()
    sizes = words.groupBy("label").agg(F.sum("c").alias("words")).join(
        docs.withColumnRenamed(label, "label"), "label").withColumn("vocabulary", vocabulary)
    return words, cut_lineage(sizes)  # a row per class


def classify(seqs: DataFrame, model: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """Most probable class and its posterior.

    With add-one smoothing a k-mer unseen in a class adds nothing but the class constant, so
    only k-mers the class has are joined.
    """
    words, sizes = model
    total = sizes.agg(F.sum("docs")).scalar()
    query = kmer_rows(seqs.select("seq_id", "seq"), "seq", k).groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("n"))
    query = cut_lineage(query)
    hit = query.join(words, "kmer").groupBy("seq_id", "label").agg(F.sum(F.col("n") * F.log(F.col("c") + 1)).alias("s"))
    lengths = query.groupBy("seq_id").agg(F.sum("n").alias("len"))
    classes = sizes.agg(F.collect_list(F.struct("label", "words", "docs", "vocabulary"))).scalar()
    score = (
        F.coalesce("s", F.lit(0.0)) - F.col("len") * F.log(F.col("words") + F.col("vocabulary"))
        + F.log(F.col("docs") / total))
    scored = (
        lengths.withColumn("c", F.explode(classes)).select("seq_id", "len", "c.*")
        .join(hit, ["seq_id", "label"], "left").select("seq_id", "label", score.alias("score")))
    best = scored.groupBy("seq_id").agg(
        F.max(F.struct("score", "label")).alias("b"), F.collect_list("score").alias("all"))  # a number per class
    post = F.aggregate("all", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("b.score")))
    return best.select("seq_id", F.col("b.label").alias("label"), (1 / post).alias("confidence"))


def lineage_prefixes(lineage: Column, sep: str = ";") -> Column:
    """The lineage cut at every rank, from the empty one (rank 0) to the whole."""
    parts = F.split(lineage, sep)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
        n.alias("rank"), F.array_join(F.slice(parts, F.lit(1), n), sep).alias("lineage")))


def classify_lineages(seqs: DataFrame, model: tuple[DataFrame, DataFrame], k: int, cutoff: float = 0.7, sep: str = ";") -> DataFrame:
    """(seq_id, rank, lineage, confidence): the lineage of the most probable class, as deep as it is sure.

    Labels of the ``model`` are lineages. The confidence at a rank is the posterior of all classes
    below it; the deepest rank with at least ``cutoff`` is kept, rank 0 being the empty lineage.
    A class that shares no k-mer with a sequence scores by the sequence's length alone, so those are
    added once for each length; only classes that share one are listed for a sequence. Sequences
    shorter than ``k`` have no k-mer and no row.
    """
    words, sizes = model
    total = sizes.agg(F.sum("docs")).scalar()
    query = cut_lineage(kmer_rows(seqs.select("seq_id", "seq"), "seq", k).groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("n")))
    lengths = cut_lineage(query.groupBy("seq_id").agg(F.sum("n").alias("len")))
    classes = sizes.select("label", F.log(F.col("words") + F.col("vocabulary")).alias("per_word"), F.log(F.col("docs") / total).alias("prior"))
    base = F.col("prior") - F.col("len") * F.col("per_word")
    # distinct lengths: as many as the longest sequence allows, however many sequences there are
    lens = lengths.agg(F.collect_set("len")).scalar()
    alone = cut_lineage(spread(classes, "label").select("*", F.explode(lens).alias("len")).select("label", "len", base.alias("base")))
    top = cut_lineage(alone.groupBy("len").agg(F.max(F.struct(F.col("base").alias("score"), "label")).alias("top")))
    mass = alone.join(top, "len").select("len", F.exp(F.col("base") - F.col("top.score")).alias("p"), F.explode(
        lineage_prefixes(F.col("label"), sep)).alias("at")).groupBy("len", "at.lineage").agg(F.sum("p").alias("mass"))
    hits = query.join(words, "kmer").groupBy("seq_id", "label").agg(F.sum(F.col("n") * F.log(F.col("c") + 1)).alias("s"))
    hits = cut_lineage(hits.join(lengths, "seq_id").join(classes, "label").select("seq_id", "label", "s", (base + F.col("s")).alias("score")))
    best = lengths.join(hits.groupBy("seq_id").agg(F.max(F.struct("score", "label")).alias("b")), "seq_id", "left").join(top, "len")
    best = cut_lineage(best.withColumn("b", F.greatest("b", "top")).select(
        "seq_id", "len", F.col("b.score").alias("most"), F.col("top.score").alias("top"),
        lineage_prefixes(F.col("b.label"), sep).alias("path")))
    # what a hit adds to its class's score without hits, at the ranks it shares with the best class
    more = hits.join(best.select("seq_id", "most", "path"), "seq_id").select(
        "seq_id", (F.exp(F.col("score") - F.col("most")) * (1 - F.exp(-F.col("s")))).alias("p"),
        F.explode(F.array_intersect("path", lineage_prefixes(F.col("label"), sep))).alias("at"))
    more = more.groupBy("seq_id", "at.lineage").agg(F.sum("p").alias("more"))
    path = best.select("seq_id", "len", F.exp(F.col("top") - F.col("most")).alias("scale"), F.inline("path"))
    path = path.join(mass, ["len", "lineage"]).join(more, ["seq_id", "lineage"], "left").select(
        "seq_id", "rank", "lineage", (F.col("mass") * F.col("scale") + F.coalesce("more", F.lit(0.0))).alias("p"))
    whole = path.filter("rank = 0").select("seq_id", F.col("p").alias("whole"))
    sure = path.join(whole, "seq_id").withColumn("confidence", F.col("p") / F.col("whole")).filter(
        (F.col("confidence") >= cutoff) | (F.col("rank") == 0))
    deepest = sure.groupBy("seq_id").agg(F.max(F.struct("rank", "lineage", "confidence")).alias("d"))
    return deepest.select("seq_id", "d.rank", "d.lineage", "d.confidence")


# ---- contigs --------------------------------------------------------------------------------


def cut_contigs(seqs: DataFrame, size: int = PIECE) -> DataFrame:
    """Pieces of ``size``; what is left over is merged into the last piece."""
    n = F.length("seq")
    pieces = F.greatest(F.floor(n / F.lit(size)).cast("int"), F.lit(1))
    parts = seqs.withColumn("_n", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    last = F.col("piece") == F.col("_n") - 1
    return parts.select(
        "seq_id", "piece",
        F.substring(F.col("seq"), F.col("piece") * size + 1, F.when(last, n).otherwise(F.lit(size))).alias("seq"))


def merge_pieces(piece_clusters: DataFrame) -> DataFrame:
    """Cluster of a contig by majority of its pieces; ties go to the smallest name."""
    votes = piece_clusters.groupBy("seq_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    top = keep_max(votes, ["seq_id"], "n")
    return top.groupBy("seq_id").agg(F.min("cluster").alias("cluster"), F.max("n").alias("votes"))


def extract_bins(seqs: DataFrame, members: DataFrame, path: str) -> None:
    """Sequences of each bin under its own folder."""
    seqs.join(members.select("seq_id", "bin"), "seq_id").write.partitionBy("bin").parquet(path)


def assembly_stats(seqs: DataFrame, by: str) -> DataFrame:
    """Contigs, total length, N50 and GC share per assembly."""
    gc = F.length("seq") - F.length(F.translate(F.lower("seq"), "gc", ""))
    rows = seqs.select(by, F.length("seq").cast("bigint").alias("len"), gc.cast("bigint").alias("gc"))
    base = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("contigs"), F.sum("len").alias("total"), (F.sum("gc") / F.sum("len")).alias("gc"),
        F.max("len").alias("longest"))
    cum = running_total(rows.select(by, "len", F.col("len").alias("w")), [by], "len", "w", "cum", descending=True)
    n50 = cum.join(base.select(by, "total"), by).filter(F.col("cum") * 2 >= F.col("total")).groupBy(by).agg(
        F.max("len").alias("n50"))
    return base.join(n50, by)


# ---- alignments ------------------------------------------------------------------------------


def sort_alignments(alignments: DataFrame, ref: str, pos: str, partitions: int | None = None) -> DataFrame:
    """Globally sorted by position: range partitions, each sorted on its own."""
    parts = [partitions] if partitions else []
    return alignments.repartitionByRange(*parts, ref, pos).sortWithinPartitions(ref, pos)


def _events(alignments: DataFrame, by: Sequence[str]) -> DataFrame:
    """+1 where an alignment starts and -1 past its end, summed per position."""
    ends = F.explode(F.array(
        F.struct(F.col("pos").cast("bigint").alias("at"), F.lit(1).alias("step")),
        F.struct((F.col("pos") + F.col("length")).cast("bigint").alias("at"), F.lit(-1).alias("step")))).alias("e")
    return alignments.select(*by, ends).select(*by, "e.at", F.col("e.step").cast("bigint").alias("step"))


def depth(alignments: DataFrame, by: Sequence[str] = ("ref",)) -> DataFrame:
    """(by.., start, stop, depth): runs of equal depth, half open, covered ones only."""
    by = list(by)
    run = cut_lineage(running_total(_events(alignments, by), by, "at", "step", "depth"))
    out = next_value(run.select(*by, "at", "depth"), by, "at", "stop")
    return out.filter((F.col("depth") > 0) & (F.col("stop") > F.col("at"))).withColumnRenamed("at", "start")


def coverage_table(alignments: DataFrame, by: Sequence[str] = ("ref",)) -> DataFrame:
    """Aligned bases, covered positions and mean depth over covered positions.

    Covered positions come from the running depth without listing positions: the sum of
    the points where depth falls to 0 less those where it leaves 0.
    """
    by = list(by)
    bases = alignments.groupBy(*by).agg(F.sum("length").cast("bigint").alias("bases"))
    run = running_total(_events(alignments, by), by, "at", "step", "depth")
    before = F.col("depth") - F.col("step")
    edge = F.when((F.col("depth") == 0) & (before > 0), F.col("at")).when((F.col("depth") > 0) & (before == 0), -F.col("at"))
    covered = run.groupBy(*by).agg(F.sum(F.coalesce(edge, F.lit(0))).cast("bigint").alias("covered"))
    return bases.join(covered, by).withColumn("mean_depth", F.col("bases") / F.col("covered"))


def idxstats(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("ref").agg(
        F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("mapped"), F.count_if(F.col("flag").bitwiseAND(4) != 0).alias("unmapped"))


def flagstat(alignments: DataFrame) -> DataFrame:
    bit = lambda b: F.count_if(F.col("flag").bitwiseAND(b) != 0)
    return alignments.agg(
        F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - bit(4)).alias("mapped"), bit(1).alias("paired"),
        bit(2).alias("proper_pair"), bit(256).alias("secondary"), bit(1024).alias("duplicates"))


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Transcripts per million from counts and feature lengths."""
    rate = counts.join(lengths, "feature_id").withColumn("_r", F.col("abundance") / F.col("length"))
    total = rate.groupBy("sample_id").agg(F.sum("_r").alias("_t"))
    return rate.join(total, "sample_id").select(
        "sample_id", "feature_id", "abundance", (F.col("_r") / F.col("_t") * 1e6).alias("tpm"))


# ---- hits and genomes --------------------------------------------------------------------------


def filter_hits(hits: DataFrame, pident: float = 0, bitscore: float = 0, evalue: float = 10) -> DataFrame:
    return hits.filter((F.col("pident") >= pident) & (F.col("bitscore") >= bitscore) & (F.col("evalue") <= evalue))


def best_identity(hits: DataFrame) -> DataFrame:
    return keep_max(hits, ["query"], "pident")


def mag_quality(report: DataFrame, taxonomy: DataFrame, completeness: float = 90, contamination: float = 5) -> DataFrame:
    good = report.filter((F.col("completeness") > completeness) & (F.col("contamination") < contamination))
    return good.join(taxonomy, "genome")
