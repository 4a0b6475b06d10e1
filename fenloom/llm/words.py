"""Texts as arrays of coded words, in units of bounded size, for operators that work in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

UNIT = 4 << 20


@contextmanager
def batches_of(spark: SparkSession, rows: int = 500):
    """Fewer rows at once to Python workers while the block runs; the session's setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def flags(chars: bytes) -> np.ndarray:
    """A table over byte values that is true for ``chars``."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def units(batch: pa.RecordBatch, text: int = -1, limit: int = UNIT) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts as UTF-8) of runs of rows of about ``limit`` bytes; a longer text is alone."""
    column = batch.column(text % batch.num_columns)
    first, held, size = 0, [], 0
    for i in range(batch.num_rows):
        t = column[i].as_py()
        raw = b"" if t is None else t.encode()
        if held and size + len(raw) > limit:
            yield first, i, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, batch.num_rows, held


def coded(data: bytes, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The runs of bytes outside ``breaks``: where each starts, its code, and the distinct runs by code."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~breaks[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[inside])])
    found = runs.dictionary_encode()
    return starts, found.indices.to_numpy(), found.dictionary


def joined(texts: Sequence[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with a line feed after each, and where each begins."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return b"\n".join([*texts, b""]), at
