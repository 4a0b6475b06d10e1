"""Token ids of documents in files that give short documents back cheaply.

Documents are encoded in ascending id order. A row of the files is a block of documents: their
ids, counts, an index of byte offsets, the hash of the compression dictionary, and one payload
holding a separate zstandard frame per document. The frames share a dictionary trained on a
bounded sample of serialised id arrays, stored beside the blocks, so that a short document
compresses well yet needs only its own frame to be read. The container is Parquet, as any store
Spark reaches can then hold it.

Layout of the folder: ``dictionary/`` (hash, bytes, id width) and ``blocks/`` (shard, block,
doc_ids, counts, offsets, dictionary, payload). Shards follow the order of ids; the ids of a row
group of equal doc ids are ordered by a hash of their text. Null text gives only the end id;
null doc ids come first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.taskcontext import TaskContext

from fenloom.llm.common import once, text_of
from fenloom.llm.tokens import RunEncoder
from fenloom.llm.words import batches_of, units

BLOCK_BYTES = 1 << 20


class Encoder:
    """A tokenizers file whose runs of characters are encoded once each, with serialised ids.

    ``whole`` encodes a text at once and must agree (see the tests).
    """

    def __init__(self, path: str):
        self.runs = RunEncoder(path)
        self.width = 2 if self.runs.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.whole = self.runs.whole

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Serialised ids of each text, the end id last."""
        ids, begin = self.runs.encode(texts, end)
        raw, at = ids.astype(f"<u{self.width}").tobytes(), (begin * self.width).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def encoder(path: str) -> Encoder:
    return once(("encoder", path), lambda: Encoder(path))


def _ids_of(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, texts in units(b):
                yield pa.RecordBatch.from_arrays([pa.array(encoder(path).encode(texts, end), pa.binary())], names=["ids"])

    return run


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, path: str, end: int, sample: int, size: int) -> bytes:
    """A dictionary from the id arrays of about ``sample`` documents, of each at most the 16 KB a window can use."""
    n = max(1, docs.count())
    draw = F.pmod(F.xxhash64(F.lit("dictionary"), id_col), F.lit(1 << 30)) / float(1 << 30)
    few = docs.filter(draw * n < sample).select(text_of(F.col(text_col)).alias("text"))
    cut = F.substring("ids", 1, 1 << 14)
    got = few.mapInArrow(_ids_of(path, end), "ids binary").select(cut.alias("ids")).toPandas()["ids"]
    try:
        return zstandard.train_dictionary(size, sorted(bytes(x) for x in got)).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b""


def _frames(path: str, end: int, dictionary: bytes, level: int):
    name = hashlib.sha256(dictionary).hexdigest()[:16]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_dict_id=False, write_content_size=True)
        shard, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal block, size
            frames = [h[2] for h in held]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([[h[0] for h in held]], pa.list_(kind)),
                 pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                 pa.array([name]), pa.array([b"".join(frames)], pa.binary())],
                names=["shard", "block", "doc_ids", "counts", "offsets", "dictionary", "payload"])
            held.clear()
            block, size = block + 1, 0
            return out

        for b in batches:
            kind = b.column(0).type
            coder = encoder(path)
            for lo, hi, texts in units(b, 1):
                for doc, ids in zip(b.column(0).slice(lo, hi - lo).to_pylist(), coder.encode(texts, end)):
                    frame = pack.compress(ids)
                    held.append((doc, len(ids) // coder.width, frame))
                    size += len(frame)
                    if size >= BLOCK_BYTES:
                        yield flush()
        if held:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text",
          sample: int = 1000, dictionary_size: int = 1 << 16, level: int = 3, shards: int | None = None) -> None:
    """Encodes all documents and writes the folder.

    ``sample`` documents, chosen by a hash of their id, train the dictionary.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with batches_of(spark):
        dictionary = train_dictionary(docs, "id", "text", path, end, sample, dictionary_size)
    width = encoder(path).width
    spark.range(1).select(F.lit(hashlib.sha256(dictionary).hexdigest()[:16]).alias("hash"), F.lit(bytearray(dictionary)).alias("bytes"),
                          F.lit(width).alias("width")).write.parquet(f"{folder}/dictionary")
    # ranges keep the order of ids over shards; the text's hash splits a very common id
    tie = F.xxhash64("text")
    parts = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = docs.repartitionByRange(parts, "id", tie).sortWithinPartitions("id", tie)
    kind = dict(docs.dtypes)["id"]
    with batches_of(spark):
        ordered.mapInArrow(
            _frames(path, end, dictionary, level),
            f"shard int, block int, doc_ids array<{kind}>, counts array<long>, offsets array<long>, dictionary string, payload binary",
        ).write.parquet(f"{folder}/blocks")


def _opened(spark: SparkSession, folder: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(bytes(row["bytes"])).hexdigest()[:16] != row["hash"]:
        raise ValueError("the dictionary does not match its hash")
    return row["hash"], bytes(row["bytes"]), row["width"]


def _unpack(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=shared)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its frame.

    ``start`` adds the totals of all shards before, a row for each shard, to the place inside the shard.
    """
    name, dictionary, width = _opened(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.groupBy("shard", "block").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    inside = totals.select("shard", "block", before.alias("inside"))
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    starts = inside.join(base, "shard").select("shard", "block", (F.col("inside") + F.col("base")).alias("first"))
    kind = dict(blocks.dtypes)["doc_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpack(dictionary)
        for b in batches:
            for r in b.to_pylist():
                if r["dictionary"] != name:
                    raise ValueError("a block was written with another dictionary")
                crc, n, at = [], [], r["offsets"]
                for a, e in zip(at[:-1], at[1:]):
                    ids = np.frombuffer(unpack.decompress(r["payload"][a:e]), f"<u{width}")
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                start = r["first"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array(start), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(starts, ["shard", "block"]).select("doc_ids", "offsets", "dictionary", "payload", "first").mapInArrow(
        run, f"doc_id {kind[6:-1]}, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, folder: str, doc_ids: list) -> dict:
    """The ids of a few documents, decompressing their frames only."""
    _, dictionary, width = _opened(spark, folder)
    unpack, out = _unpack(dictionary), {}
    blocks = spark.read.parquet(f"{folder}/blocks")
    at = F.explode(F.arrays_zip("doc_ids", F.slice("offsets", F.lit(1), F.size("doc_ids")).alias("a"),
                                F.slice("offsets", F.lit(2), F.size("doc_ids")).alias("e")))
    wanted = blocks.filter(F.arrays_overlap("doc_ids", F.array(*map(F.lit, doc_ids)))).select("payload", at.alias("d"))
    frames = wanted.filter(F.col("d.doc_ids").isin(doc_ids)).select(
        "d.doc_ids", F.expr("substring(payload, cast(d.a + 1 as int), cast(d.e - d.a as int))").alias("frame"))
    for doc, frame in frames.collect():
        out[doc] = np.frombuffer(unpack.decompress(bytes(frame)), f"<u{width}").astype(np.int64)
    return out
