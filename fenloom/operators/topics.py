"""Latent communities by topic modelling of the count table (MLlib LDA)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, functions as F

from fenloom.operators.community import RANKS, parse_lineage
from fenloom.operators.tidy import ordinal_ids, top_n
from fenloom.session import cut_lineage


def feature_index(counts: DataFrame) -> DataFrame:
    """(feature_id, idx): dense numbers from 0 in a stable order; the model's vocabulary."""
    return ordinal_ids(counts, "feature_id", "", "idx").withColumn("idx", F.col("idx").cast("int") - 1)


def sample_vectors(counts: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """One sparse vector per sample, as MLlib takes it; its length is the vocabulary."""

    @F.udf(VectorUDT())
    def to_vector(pairs):
        return SparseVector(size, [(p["idx"], float(p["abundance"])) for p in pairs])

    per = counts.groupBy("sample_id", "feature_id").agg(F.sum("abundance").alias("abundance")).join(index, "feature_id")
    return per.groupBy("sample_id").agg(
        to_vector(F.sort_array(F.collect_list(F.struct("idx", "abundance")))).alias("features"))


@dataclass
class Communities:
    theta: DataFrame  # (sample_id, topic, probability)
    phi: DataFrame  # (topic, feature_id, probability)
    log_likelihood: float


def communities(counts: DataFrame, k: int = 4, seed: int = 125, iters: int = 20, beta: float = 1.0) -> Communities:
    """``k`` latent communities with prior weight ``beta`` on every feature.

    The online optimiser over all samples per round; model size is topics x features.
    """
    from pyspark.ml.clustering import LDA

    index = cut_lineage(feature_index(counts))
    size = index.count()
    # sorted so that the seeded start meets the samples in one order
    data = cut_lineage(sample_vectors(counts, index, size).orderBy("sample_id"))
    lda = LDA(k=k, maxIter=iters, seed=seed, optimizer="online", subsamplingRate=1.0, topicConcentration=beta,
              optimizeDocConcentration=False, docConcentration=[1.0] * k, learningOffset=1.0, learningDecay=0.51)
    model = lda.fit(data)
    from pyspark.ml.functions import vector_to_array

    theta = model.transform(data).select(
        "sample_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "probability"))
    terms = model.describeTopics(size).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
    phi = terms.select("topic", F.col("t.termIndices").alias("idx"), F.col("t.termWeights").alias("probability")).join(
        index, "idx").drop("idx")
    return Communities(theta, phi, float(model.logLikelihood(data)))


def topic_top(phi: DataFrame, taxonomy: DataFrame, n: int = 5, rank: str = "genus", unknown: str = "Unknown") -> DataFrame:
    """Topic composition by rank, the ``n`` largest per topic with ties."""
    name = dict(zip(RANKS, parse_lineage("lineage")))[rank]
    named = taxonomy.select("feature_id", F.coalesce(name, F.lit(unknown)).alias(rank))
    sums = phi.join(named, "feature_id", "left").groupBy("topic", rank).agg(F.sum("probability").alias("total"))
    return top_n(sums, n, ["topic"], "total")


def topic_by_group(theta: DataFrame, samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Topic membership of each sample beside its grouping columns."""
    return theta.join(samples.select("sample_id", *by), "sample_id")


def likelihood_trace(counts: DataFrame, k: int, seed: int, iters: Sequence[int], beta: float = 1.0) -> DataFrame:
    """Log likelihood of the model after each number of rounds."""
    rows = [(int(i), communities(counts, k, seed, int(i), beta).log_likelihood) for i in iters]
    return counts.sparkSession.createDataFrame(rows, "iterations int, log_likelihood double")
