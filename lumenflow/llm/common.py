"""What the corpus operators share: size-checked joins, Arrow helpers, checkpoints."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A small side of a join is broadcast up to so many rows, counted first; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Where it is unset, a local master gets a temporary folder; a cluster must name a shared one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "lumenflow-checkpoints"))
    return df.checkpoint()


def checked(small: DataFrame) -> DataFrame:
    """`small` (checkpointed) marked for broadcast if it has at most BROADCAST_ROWS rows, counted; else as it is, for a join by shuffle."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def fresh(df: DataFrame, name: str) -> str:
    """A start of names that no column of df has."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def _by_ids(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    name = fresh(docs, "__id")
    return docs.join(checked(ids.toDF(name)), docs[key] == F.col(name), how)


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key isn't in the one-column `ids` (checkpointed); rows with a null key stay."""
    return _by_ids(docs, ids, key, "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is in `ids`; as without_ids."""
    return _by_ids(docs, ids, key, "left_semi")


def release() -> None:
    """Hand freed memory back to the system, which allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that hands freed memory back when its partition is done: Python workers live on between tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
