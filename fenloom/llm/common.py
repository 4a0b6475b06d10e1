"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fenloom.session import cut_lineage, scratch_path

#: A word: a run of letters or digits, or of anything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(text_of(column), UPPER, LOWER)


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct, so that no helper column can clash with them."""
    names = docs.columns
    if len(set(n.lower() for n in names)) < len(names):
        raise ValueError(f"column names must differ: {names}")
    return docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))


def unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(n).alias(n) for n in names])


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Rows kept away from training, by the checksum of the id (a null id counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder


def bounded_sample(rows: DataFrame, key: Column, per_class: int, by: str) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, by a hash of ``key``; all rows where there are fewer.

    Which rows are taken depends on their key alone, not on partitions.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(sizes), by).filter(draw * F.col("_n") < per_class).drop("_n")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of links between longs: (id, component), component being its smallest id.

    Alternates stars around larger and smaller neighbours until nothing changes; only
    links are shuffled, and each round is written to the shared folder.
    """
    e = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        e = cut_lineage(small.select("p.*").filter("u <> v").distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Fewer rows at once to Python workers: a thousand long texts must fit one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts, with the end of the last, and the bytes; offsets have 64 bits in large strings."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    starts = np.frombuffer(texts.buffers()[1], width)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    return starts, np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)


def once(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in each Python process.

    Task functions are shipped by value, so a module's own variables start anew with every task;
    this store lives as long as the worker.
    """
    store = sys.modules.setdefault("_fenloom_once", types.ModuleType("_fenloom_once")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def in_blocks(rows: DataFrame, place: Sequence[str], member: str, block: int) -> DataFrame:
    """Rows of places with more than one member, with ``block, bi, bj``: the tiles a row is needed in.

    A place is cut into blocks of about ``block`` members, and each pair of blocks is a tile, so
    that every two members of a place meet in one tile and no tile grows with its place.
    """
    place = list(place)
    sizes = rows.groupBy(place).agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = rows.join(sizes, place).withColumn("_nb", F.ceil(F.col("_n") / block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), member), "_nb").cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda k: F.struct(
        F.least("block", k).alias("bi"), F.greatest("block", k).alias("bj")))
    return rows.select("*", F.inline(tiles)).drop("_n", "_nb")


def by_tile(rows: DataFrame, tile: Sequence[str], work: Callable[[tuple, pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on the rows of each tile; only one tile at a time is held."""
    tile = list(tile)
    width = len(tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done():
            return work(last, pa.Table.from_batches(held)) if sum(h.num_rows for h in held) > 1 else None

        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in range(width)]))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if keys[lo] != last:
                    if (out := done()) is not None:
                        yield out
                    held.clear()
                last = keys[lo]
                held.append(b.slice(lo, hi - lo))
        if (out := done()) is not None:
            yield out

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in rows.columns if c not in tile]
    return rows.select(*tile, *rest).repartition(parts, *tile).sortWithinPartitions(*tile).mapInArrow(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number in each component of links between numbers below ``n``."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def chunked(rows: DataFrame, chunks: int, name: str) -> DataFrame:
    """``rows`` written with their ``chunk``, the partition that numbered their ``rid``.

    The table is bucketed by chunk: what is known of a chunk joins its rows without moving them.
    """
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    rows.withColumn("chunk", F.shiftright("rid", 33)).write.bucketBy(max(1, chunks), "chunk").option(
        "path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def chosen(table: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of a :func:`chunked` table whose ``rid`` is among ``rids``; only bits are shuffled."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pos = part["pos"].to_numpy()
        flags = np.zeros((int(pos.max()) + 64) // 64 * 64, np.uint8)
        flags[pos] = 1
        return pd.DataFrame({"chunk": [key[0]], "words": [np.packbits(flags, bitorder="little").view("<i8")]})

    pos = F.col("rid").bitwiseAND((1 << 33) - 1)
    bits = rids.select(F.shiftright("rid", 33).alias("chunk"), pos.alias("pos")).groupBy("chunk").applyInPandas(
        pack, "chunk long, words array<long>")
    bit = F.expr("bit_get(get(words, cast(shiftright(rid & 8589934591, 6) AS int)), cast(rid & 63 AS int)) = 1")
    return table.join(bits.hint("shuffle_hash"), "chunk").filter(bit).drop("words", "chunk")
