"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every partition sorts its fingerprints and sends them, Golomb-Rice coded, to the owners of
fingerprint ranges. An owner answers each message with a bitmap of the rows whose fingerprint
was also sent by another row. Only these suspects are shuffled with their bytes, where equal
texts are found by grouping on the text itself, so a fingerprint collision changes nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fenloom.llm.common import GAP, chosen, packed, text_of, unpacked
from fenloom.session import cut_lineage, scratch_path


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative integers below 2**63 as coded gaps.

    Layout: one byte k; the quotients in unary, each ended by a 1; then k low bits of each gap.
    """
    if len(values) == 0:
        return b"\0"
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    k = max(0, int(math.log2(max(1.0, gaps.mean()))))
    unary = np.zeros(int((gaps >> k).sum()) + len(gaps), np.uint8)
    unary[np.cumsum((gaps >> k) + 1) - 1] = 1
    low = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1 if k else np.zeros((0, 0))
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes()


def golomb_decode(code: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    k, raw = code[0], np.frombuffer(code, np.uint8, offset=1)
    low_bytes = (n * k + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - low_bytes]))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << k
    if k:
        bits = np.unpackbits(raw[len(raw) - low_bytes:])[: n * k].reshape(n, k)
        for i in range(k):
            gaps |= bits[:, i].astype(np.int64) << (k - 1 - i)
    return np.cumsum(gaps)


MESSAGE = "chunk long, first long, n_rows long, owner long, n long, code binary, again binary"
BITMAP = "chunk long, first long, n_rows long, bits binary"


def _messages(owner_shift: int):
    """One message per run of rows and owner; rows come sorted by fingerprint within a chunk."""

    def message(chunk: int, first: int, fp: np.ndarray) -> Iterator[dict]:
        owners = fp >> owner_shift
        cuts = np.flatnonzero(np.diff(owners)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(fp)]):
            part = fp[lo:hi] & ((1 << owner_shift) - 1)
            values, counts = np.unique(part, return_counts=True)
            # rows of one fingerprint within the run are named by count, not sent again
            more = np.flatnonzero(counts > 1)
            again = np.stack([more, counts[more]]).astype(np.int64).tobytes()
            yield dict(chunk=chunk, first=first + int(lo), n_rows=int(hi - lo), owner=int(owners[lo]), n=len(values),
                       code=golomb_encode(values), again=again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("first", pa.int64()), ("n_rows", pa.int64()),
                            ("owner", pa.int64()), ("n", pa.int64()), ("code", pa.binary()), ("again", pa.binary())])
        held: list[np.ndarray] = []

        def flush():
            rows = np.concatenate(held, axis=1)
            held.clear()
            cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 1)) + 1
            out = [m for lo, hi in zip([0, *cuts], [*cuts, rows.shape[1]])
                   for m in message(int(rows[0, lo]), int(rows[1, lo]), rows[2, lo:hi])]
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for b in batches:
            if b.num_rows:
                held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
            if sum(h.shape[1] for h in held) >= 1_000_000:
                yield flush()
        if held:
            yield flush()

    return run


def _answers(key: tuple, messages: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: a bit per row of each message, set where the fingerprint has another row."""
    sent = [golomb_decode(c, n) for c, n in zip(messages["code"], messages["n"])]
    values, where, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared, at, out = counts[where] > 1, 0, []
    for i, s in enumerate(sent):
        flag, times = shared[at: at + len(s)].copy(), np.ones(len(s), np.int64)
        at += len(s)
        more, count = np.frombuffer(messages["again"].iloc[i], np.int64).reshape(2, -1)
        times[more] = count
        flag[more] = True
        out.append(np.packbits(np.repeat(flag, times)).tobytes())
    return messages[["chunk", "first", "n_rows"]].assign(bits=out)


def _assemble(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """The bitmaps of a chunk as one array of 64-bit words."""
    size = int((parts["first"] + parts["n_rows"]).max())
    flags = np.zeros((size + 63) // 64 * 64, np.uint8)
    for first, n, bits in zip(parts["first"], parts["n_rows"], parts["bits"]):
        flags[first: first + n] = np.unpackbits(np.frombuffer(bits, np.uint8))[:n]
    words = np.packbits(flags, bitorder="little").view("<i8")
    return pd.DataFrame({"chunk": [key[0]], "words": [words]})


class ExactDedup:
    """The decisions of one run over ``docs``, as DataFrames over tables in the shared folder.

    Null text counts as empty, empty texts are equal to each other; rows repeated with one id
    and text are one group of which exactly one row stays; a null id comes after all others.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 48,
                 owner_rows: int = 1_000_000):
        spark = docs.sparkSession
        self.names = docs.columns
        norm = F.regexp_replace(text_of(F.col("row").getField(text_col)), GAP, " ")
        self.norm = norm
        rows = packed(docs).withColumn("norm", norm).select(
            "row", F.col("row").getField(id_col).alias("id"), F.sha2(F.col("norm"), 256).alias("sha"),
            F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits).alias("fp"))
        # the place of a row: its partition, and its position there in the order of fingerprints
        rows = rows.sortWithinPartitions("fp").withColumn("rid", F.monotonically_increasing_id()).select(
            "*", F.shiftright("rid", 33).alias("chunk"), F.col("rid").bitwiseAND((1 << 33) - 1).alias("pos"))
        chunks = max(1, packed(docs).rdd.getNumPartitions())
        # bucketed by chunk, so that a bitmap comes back to its rows without moving them
        self.table = f"exact_{uuid.uuid4().hex}"
        rows.write.bucketBy(chunks, "chunk").option("path", scratch_path(spark, "exact")).saveAsTable(self.table)
        self.spool = spool = spark.table(self.table)
        n = spool.count()
        owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n / owner_rows, 1)
        owner_bits = min(bits, math.ceil(math.log2(owners)))
        bitmaps = (spool.select("chunk", "pos", "fp").mapInArrow(_messages(bits - owner_bits), MESSAGE)
                   .groupBy("owner").applyInPandas(_answers, BITMAP)
                   .groupBy("chunk").applyInPandas(_assemble, "chunk long, words array<long>"))
        bitmaps = cut_lineage(bitmaps, "bitmaps")
        self.rows = spool.join(bitmaps.hint("shuffle_hash"), "chunk").withColumn(
            "suspect", F.expr("bit_get(element_at(words, cast(shiftright(pos, 6) + 1 AS int)), cast(pos & 63 AS int)) = 1")
        ).drop("words")
        # equal bytes: one partial row per text and task, however many copies there are
        best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
        self.classes = cut_lineage(
            self.rows.filter("suspect").select("id", "rid", "sha", norm.alias("norm"))
            .groupBy("norm", "sha").agg(best.alias("best"), F.count("*").alias("group_size"))
            .select("sha", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size"),
            "classes")

    def report(self) -> DataFrame:
        """A row per document with the group it belongs to."""
        cols = ["id", "keep_id", "group_size", "kept", "text_sha256"]
        alone = self.rows.filter("not suspect").select(
            "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
            F.col("sha").alias("text_sha256"))
        grouped = (self.rows.filter("suspect").select("id", "rid", "sha").join(self.classes, "sha")
                   .select("*", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256")))
        return alone.select(cols).unionByName(grouped.select(cols))

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns they came with; they are picked where they lie."""
        alone = self.rows.filter("not suspect").select("row")
        first = chosen(self.spool.select("rid", "chunk", "row"), self.classes.select(F.col("keep_rid").alias("rid"))).select("row")
        return unpacked(alone.unionByName(first), self.names)
