"""Importance resampling towards a target: hashed word features scanned by an Aho-Corasick dictionary.

The distinct words of a unit of texts (a few megabytes) make an automaton of patterns with a space
on either side, so that a pattern matches whole words only. Each carries one number, the word's
CRC-32 and its length. A scan of a text emits these numbers in order; the checksum of a run of
words follows from those of its words and their lengths, so longer features are composed from
adjacent numbers without touching the text again. Checksums modulo ``buckets`` are counted in all
documents and in the target, a bucket's gain is the log ratio of the two, and a document's weight
the mean gain of its features. A seeded Gumbel draw over weights picks the sample.

Counts of a document are kept in the shared folder, a row of distinct buckets each, so texts are
scanned once. The draw ranks scores by ranges, never in one task.

Null and empty texts have no features, weight 0, and are not drawn. Null ids hash as an empty id
and come first among equal scores; repeated rows are drawn like others, each with a rank of its
own. An empty target or empty documents give counts of 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fenloom.llm.common import WORD
from fenloom.llm.words import batches_of, units
from fenloom.session import cut_lineage

LIMIT = 1 << 31  # lengths and checksums share one 64-bit number

#: Lower case for A-Z; all but digits, letters and bytes outside ASCII become spaces.
CLEAN = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


# ---- checksums of joined strings ---------------------------------------------------------------


def _byte_step() -> np.ndarray:
    """The register after one more zero byte, for each low byte (reflected CRC-32)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where((x >> np.uint32(i)) & np.uint32(1), columns[i], np.uint32(0))
    return out


class Joiner:
    """Checksums of strings put together, from their checksums and lengths."""

    def __init__(self):
        one, step = np.uint32(1) << np.arange(32, dtype=np.uint32), _byte_step()
        power = (one >> np.uint32(8)) ^ step[one & np.uint32(255)]
        self.powers = []
        for _ in range(31):  # the register after 2^k zero bytes, for each bit
            self.powers.append(power)
            power = _apply(power, power)

    def join(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC-32 of a + b from those of a and b and the bytes of b."""
        out = left.astype(np.uint32)
        for k in range(int(length.max(initial=0)).bit_length()):
            on = np.flatnonzero((length >> k) & 1)
            out[on] = _apply(self.powers[k], out[on])
        return out ^ right.astype(np.uint32)


# ---- scanning ------------------------------------------------------------------------------------


def dictionary(texts: list[bytes]):
    """The automaton of the distinct words of cleaned texts; None without words."""
    import ahocorasick

    words = set().union(*(t.split() for t in texts))
    if not words:
        return None
    auto = ahocorasick.Automaton()  # its own integers have 32 bits only
    for w in words:
        if len(w) >= LIMIT:
            raise ValueError("a word of 2 GB or more")
        auto.add_word(f" {w.decode()} ", len(w) << 32 | zlib.crc32(w))
    auto.make_automaton()
    return auto


def emitted(auto, text: bytes) -> np.ndarray:
    """What the automaton emits along a cleaned text: a number for each word, in order."""
    if auto is None:
        return np.zeros(0, np.int64)
    return np.fromiter(map(itemgetter(1), auto.iter(f" {text.decode()} ")), np.int64)


def features(payload: np.ndarray, lo: int, hi: int, joiner: Joiner) -> np.ndarray:
    """Checksums of all runs of ``lo`` to ``hi`` words joined by one space."""
    crc, length = (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32
    out, run = [crc] if lo == 1 else [], crc
    if hi > 1:
        led = joiner.join(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, length)  # " " + word
        for n in range(2, hi + 1):
            run = joiner.join(run[:-1], led[n - 1:], length[n - 1:] + 1)
            if n >= lo:
                out.append(run)
    return np.concatenate(out) if out else crc[:0]


def _scan(lo: int, hi: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner()
        for b in batches:
            for first, last, texts in units(b):
                texts = [t.translate(CLEAN) for t in texts]
                auto = dictionary(texts)
                n_words, n_features, at, number = [], [], [], []
                for t in texts:
                    payload = emitted(auto, t)
                    found = features(payload, lo, hi, joiner)
                    place, n = np.unique(found % np.uint32(buckets), return_counts=True)
                    n_words.append(len(payload))
                    n_features.append(len(found))
                    at.append(place.astype(np.int32))
                    number.append(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                     pa.array(at, pa.list_(pa.int32())), pa.array(number, pa.list_(pa.int64()))],
                    names=["id", "n_words", "n_features", "buckets", "counts"])

    return run


def scanned(docs: DataFrame, id_col: str, text_col: str, lo: int, hi: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets, counts) of every row, written to the shared folder."""
    if not 1 <= lo <= hi or not 1 <= buckets <= 1 << 31:
        raise ValueError("1 <= lo <= hi, and 1 to 2^31 buckets")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    with batches_of(docs.sparkSession):
        return cut_lineage(rows.mapInArrow(
            _scan(lo, hi, buckets), f"id {kind}, n_words long, n_features long, buckets array<int>, counts array<long>"), "features")


# ---- weights and draw ------------------------------------------------------------------------------


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) over all scanned rows."""
    return rows.select(F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("counts").alias("n")))).groupBy(
        "bucket").agg(F.sum("n").alias("n"))


def gains(rows: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket that documents use: 1000 times the log ratio of smoothed shares, floored."""
    s, t = bucket_counts(rows), bucket_counts(target).withColumnRenamed("n", "t")
    total = rows.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0]
    wanted = target.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0]
    share = ((F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(float(total + buckets))) / (
        (F.col("n") + 1).cast("double") * F.lit(float(wanted + buckets)))
    return s.join(t, "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("gain"))


def weighed(rows: DataFrame, gain: DataFrame, buckets: int) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of a document's features."""
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():  # a row a bucket
        table[r["bucket"]] = r["gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column(3), b.column(4)
            ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))])
            total = np.concatenate([[0], np.cumsum(table[at.flatten().to_numpy()] * n.flatten().to_numpy())])
            total = total[ends[1:]] - total[ends[:-1]]
            weight = total // np.maximum(b.column(2).to_numpy(), 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "n_words", "n_features", "buckets", "counts").mapInArrow(
        run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """1000 times a Gumbel variate of the id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, eligible: Column, percent: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... of the highest scores among the eligible, ``percent`` of them; else null.

    The lowest drawn score comes from the counts of scores, whole numbers of a bounded range. Rows
    down to it are dealt by ranges of (score, id), numbered inside each, and raised by the sizes of
    the ranges before.
    """
    spark = rows.sparkSession
    rows = cut_lineage(rows.select("*", F.monotonically_increasing_id().alias("_row")), "scores")
    draw = rows.filter(eligible).count() * percent // 100
    by_score = rows.filter(eligible).groupBy(score).agg(F.count("*").alias("n"))
    reached = F.sum("n").over(Window.orderBy(F.desc(score)))  # a row a score
    least = by_score.select(score, reached.alias("n")).filter(F.col("n") >= draw).agg(F.max(score)).first()[0]
    none = F.lit(None).cast("long")
    if draw == 0:
        return rows.drop("_row").withColumn("rank", none)
    near = F.coalesce(eligible & (F.col(score) >= least), F.lit(False))
    order = [F.desc(score), F.asc_nulls_first(id_col), F.asc("_row")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), draw // 1_000_000 + 1)
    at = F.monotonically_increasing_id()
    dealt = cut_lineage(rows.filter(near).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "ranks")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    base = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_base"))  # a row a range
    rank = F.col("_base") + F.col("_at") + 1
    drawn = dealt.join(F.broadcast(base), "_part").withColumn("rank", F.when(rank <= draw, rank)).drop("_part", "_at", "_base")
    return drawn.unionByName(rows.filter(~near).withColumn("rank", none)).drop("_row")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             lo: int = 1, hi: int = 2, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn."""
    rows = scanned(docs, id_col, text_col, lo, hi, buckets)
    wanted = scanned(target, target_text, target_text, lo, hi, buckets)
    weights = weighed(rows, gains(rows, wanted, buckets), buckets)
    scores = weights.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    return ranked(scores, F.col("n_words") >= min_words, percent)


def oracle(buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> str:
    """The draw over single words in SQL, with checksums worked out byte by byte."""
    return rf"""
WITH step AS (SELECT list(c ORDER BY i) AS t FROM (
       SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                             lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
       FROM range(256) AS r(i))),
words AS (
  SELECT 0 AS part, doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') FROM benchmark),
each AS (SELECT part, n, unnest(w) AS w FROM words),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM each)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
                  lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
                lambda c, x: xor(c >> 8, t[(xor(c & 255, x) + 1)::BIGINT])), 4294967295) % {buckets} AS bucket
  FROM vocabulary, step),
counts AS (SELECT bucket, count(*) FILTER (part = 0) AS s, count(*) FILTER (part = 1) AS t FROM each JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((c.t + 1)::DOUBLE * (a.s + {buckets})::DOUBLE) / ((c.s + 1)::DOUBLE * (a.t + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM counts AS c, totals AS a),
sums AS (SELECT n, sum(gain)::BIGINT AS total FROM each JOIN hashed USING (w) JOIN gains USING (bucket) WHERE part = 0 GROUP BY n),
weights AS (
  SELECT n, doc_id, len(w)::BIGINT AS n_features,
         coalesce((total - ((total % len(w)) + len(w)) % len(w)) // len(w), 0)::BIGINT AS weight,
         ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN sums USING (n) WHERE part = 0),
scores AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score,
         n_features >= {min_words} AS eligible FROM weights),
places AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS FIRST) AS place,
         count(*) FILTER (eligible) OVER () AS eligibles FROM scores)
SELECT doc_id, n_features, weight, score,
       CASE WHEN eligible AND place <= {percent} * eligibles // 100 THEN place END AS rank
FROM places"""
