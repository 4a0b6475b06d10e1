"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated pseudo-randomly (three rounds of random signs and a fast Hadamard transform)
and hashed to the nearest of the signed axes; ``functions`` of these give a bucket, ``tables``
buckets one set of places. Each vector visits its own bucket of every table and the two next
likely ones, in which the least certain function takes its second choice. Vectors of one label
that meet in a bucket are compared by cosine in double precision.

Buckets are worked on as blocks of a matrix product. Large buckets are cut into blocks and each
pair of blocks is a tile of its own, so no task holds a whole hot bucket, and no pair is written:
a tile returns for each vector how many links it has and one link to the root of its part. A
pair that meets more than once counts where it first meets. Equal vectors (told by two 64-bit
hashes) are one class with a multiplicity.

The number of functions follows the largest label, so that buckets stay small; tables grow with
it to keep recall. Vectors that are null, empty, zero or hold null or non-finite numbers, and
vectors without a label, link with nothing; vectors of different lengths never meet. Rows
repeated with one id are separate vectors of one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fenloom.llm.common import by_tile, components, in_blocks, packed, roots
from fenloom.session import cut_lineage

PROBES = 3
TILE = ["label", "dim", "tab", "code", "bi", "bj"]


def hadamard(a: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix; the width is a power of two."""
    h, d = 1, a.shape[1]
    a = a.copy()
    while h < d:
        b = a.reshape(len(a), -1, 2 * h)
        left, right = b[:, :, :h].copy(), b[:, :, h:].copy()
        b[:, :, :h], b[:, :, h:] = left + right, left - right
        h *= 2
    return a / math.sqrt(d)


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def bucket_codes(v: np.ndarray, tables: int, functions: int, seed: int) -> np.ndarray:
    """``n x tables x PROBES`` bucket numbers, the own bucket first."""
    n, d = v.shape
    width = max(16, 1 << (d - 1).bit_length())  # with few axes there are few distinct rotations
    v = np.pad(unit_rows(v), ((0, 0), (0, width - d)))
    out, i = np.zeros((n, tables, PROBES), np.int64), np.arange(n)
    for t in range(tables):
        best, second, gap = (np.zeros((functions, n), k) for k in (np.int64, np.int64, float))
        for f in range(functions):
            rng = np.random.default_rng([seed, t, f, width])
            a = v
            for _ in range(3):
                a = hadamard(a * rng.choice([-1.0, 1.0], width))
            size = np.abs(a)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[i, top[:, 0]] < size[i, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            best[f], second[f] = (top[:, k] * 2 + (a[i, top[:, k]] > 0) for k in (0, 1))
            gap[f] = size[i, top[:, 0]] - size[i, top[:, 1]]
        unsure = np.argsort(gap, axis=0, kind="stable")
        for p in range(min(PROBES, functions + 1)):
            code = best.copy()
            if p:
                code[unsure[p - 1], i] = second[unsure[p - 1], i]
            for f in range(functions):
                out[:, t, p] = out[:, t, p] * (2 * width) + code[f]
        out[:, t, min(PROBES, functions + 1):] = out[:, t, :1]
    return out


def _hasher(tables: int, functions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
            at = lists.offsets.to_numpy()[:-1]
            codes = np.zeros((len(dims), tables * PROBES), np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                v = flat[at[rows][:, None] + np.arange(d)]
                codes[rows] = bucket_codes(v, tables, functions, seed).reshape(len(rows), -1)
            flat_codes = pa.ListArray.from_arrays(
                pa.array(np.arange(len(dims) + 1, dtype=np.int32) * tables * PROBES), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat_codes], names=["cid", "codes"])

    return run


def tile_links(v: np.ndarray, codes: np.ndarray, side: np.ndarray, tab: int, code: int, cosine: float):
    """Linked pairs (i, j) of a tile that meet here first. ``side``: 0 and 1 for the two blocks, 2 within one block."""
    cos = v @ v.T if side[0] == 2 else None
    if cos is None:
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = np.nonzero(v[one] @ v[two].T >= cosine)
        a, b = one[a], two[b]
    else:
        a, b = np.nonzero(np.triu(cos >= cosine, 1))
    x, y = codes[a], codes[b]
    first = np.ones(len(a), bool)
    for t in range(tab + 1):
        meet = x[:, t, :, None] == y[:, t, None, :]
        if t == tab:
            meet &= x[:, t, :, None] < code
        first &= ~meet.any(axis=(1, 2))
    return a[first], b[first]


def _linker(cosine: float, tables: int):
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def work(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        order = np.argsort(rows["cid"].to_numpy(), kind="stable")
        cid, copies, block = (rows[c].to_numpy()[order] for c in ("cid", "copies", "block"))
        v = unit_rows(rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)[order])
        codes = rows["codes"].combine_chunks().flatten().to_numpy().reshape(len(rows), tables, PROBES)[order]
        bi, bj = key[4], key[5]
        side = np.full(len(cid), 2) if bi == bj else (block == bj).astype(int)
        if bi != bj and (side == side[0]).all():
            return None
        a, b = tile_links(v, codes, side, key[2], key[3], cosine)
        if not len(a):
            return None
        links = np.bincount(a, copies[b], len(cid)) + np.bincount(b, copies[a], len(cid))
        root, some = cid[roots(len(cid), a, b)], links > 0
        return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], schema=schema)

    return work


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = 0.98, seed: int = 3, block: int = 2048) -> DataFrame:
    """(id, n_links, component_id, kept) for each vector."""
    spark = rows.sparkSession
    row = F.col("row")
    v = row.getField(vector_col).cast("array<double>")
    every = packed(rows).select(F.monotonically_increasing_id().alias("rid"), row.getField(id_col).alias("id"),
                                row.getField(label_col).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & finite & F.exists("v", lambda x: x != 0)
    every = every.withColumn("usable", F.coalesce(usable, F.lit(False)))
    h = [F.when(F.col("usable"), F.xxhash64(F.lit(s), "label", "v")).otherwise(F.xxhash64(F.lit(s), F.lit("alone"), "rid")) for s in (1, 2)]
    every = cut_lineage(every.withColumn("h1", h[0]).withColumn("h2", h[1]), "vectors")
    classes = cut_lineage(every.groupBy("h1", "h2").agg(
        F.min("rid").alias("cid"), F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"),
        F.first("v").alias("v"), F.first("usable").alias("usable")), "classes")

    usable = classes.filter("usable").withColumn("dim", F.size("v"))
    most = usable.groupBy("label", "dim").count().agg(F.max(F.struct("count", "dim"))).first()[0]
    functions = max(2, math.ceil(math.log(most["count"]) / math.log(2 * max(16, most["dim"])))) if most else 2
    tables = 4 + 2 * (functions - 1)
    codes = usable.select("cid", "v").mapInArrow(_hasher(tables, functions, seed), "cid long, codes array<long>")
    codes = cut_lineage(usable.join(codes, "cid").select("cid", "label", "dim", "copies", "v", "codes"), "codes")

    visits = codes.select("cid", "label", "dim", F.posexplode("codes").alias("p", "code")).select(
        "cid", "label", "dim", F.floor(F.col("p") / PROBES).cast("int").alias("tab"), "code").distinct()
    # buckets of one vector end here; large ones are cut into blocks
    visits = in_blocks(visits, ["label", "dim", "tab", "code"], "cid", block)
    full = visits.join(codes.select("cid", "copies", "v", "codes"), "cid")
    found = cut_lineage(by_tile(full, TILE, _linker(cosine, tables), "cid long, links long, root long"), "found")

    comp = components(found, "cid", "root").withColumnRenamed("id", "cid")
    of = classes.select("cid", "h1", "h2", "id", "copies", "usable").join(comp, "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    smallest = of.groupBy("component").agg(F.min("id").alias("component_id"))
    of = of.join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(smallest, "component")
    of = of.select("h1", "h2", "component_id", F.when(
        F.col("usable"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"))
    return every.select("id", "h1", "h2").join(of, ["h1", "h2"]).select(
        "id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
