"""Session helpers: the shared folder, lineage cuts and spreading of rows."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_GROUPS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; a
    cluster session must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return "/".join([shared_dir(spark), *_GROUPS, f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch_group(spark: SparkSession, name: str) -> Iterator[str]:
    """Paths that :func:`scratch_path` gives while the block runs lie below one fresh folder, so that
    they can be dropped together once no result reads them."""
    folder = scratch_path(spark, name)
    _GROUPS.append(folder.rsplit("/", 1)[1])
    try:
        yield folder
    finally:
        _GROUPS.pop()


def drop_scratch(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that :func:`scratch_group` or :func:`scratch_path` made."""
    if not folder.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{folder} is not below the shared folder")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a result that is used more than once to the shared folder and read it back.

    The written table survives lost executors, is computed once, and brings its true
    size to the planner, which a checkpointed RDD does not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys, at_least: int = 0) -> DataFrame:
    """Shuffle narrow rows evenly before a step that multiplies the work per row.

    The number of partitions is given, so that run-time coalescing, which only sees how
    small the rows are now, does not put the step into a few tasks.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), at_least)
    return df.repartition(parts, *keys)


def pieces(rows: int, per_piece: int) -> int:
    return max(1, math.ceil(rows / per_piece))
