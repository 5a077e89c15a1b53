"""Helpers that several operators share: scratch tables in the cluster's folder, and objects kept by a worker process."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revgrain.session import shared_folder

#: Broadcasts by hand stay below this many rows of a few numbers each; larger tables are joined.
BROADCAST_ROWS = 200_000
#: Keys that hold more than one in so many of a table's rows are looked up in a broadcast; there are fewer of them than that.
HOT_SHARE = 10_000
#: Bytes of a batch of rows that goes to a Python worker, unless one row alone is larger.
BATCH_BYTES = 1 << 22


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: later steps never recompute it."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined by ``key`` with ``side``, which has one row a key and says how ``many`` of ``rows`` have it.

    Keys of more than one in ``HOT_SHARE`` rows are broadcast (fewer than ``HOT_SHARE``, whatever the input), so no task
    gets all rows of a hot key; the other keys are joined.
    """
    total = rows.count()
    hot = F.broadcast(side.filter(F.col("many") * HOT_SHARE > total).drop("many"))
    cold = side.filter(F.col("many") * HOT_SHARE <= total).drop("many")
    rest = rows.join(F.broadcast(side.filter(F.col("many") * HOT_SHARE > total).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key, "left"))


def text_of(column: str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def per_worker(name: str, make):
    """An object that a Python worker makes once and keeps for its later tasks, until another operator's object takes its place."""
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if not hasattr(store, name):
        release_worker()
        setattr(store, name, make())
    return getattr(store, name)


def release_worker() -> None:
    """Let go of what this worker keeps for other operators, so that stages in a row don't add up their memory."""
    store = sys.modules.get("_kept_by_worker")
    kept = [n for n in vars(store) if not n.startswith("__")] if store else []
    for name in kept:
        delattr(store, name)
    give_back()


def give_back() -> None:
    """Return what Arrow holds in reserve to the system."""
    pa.default_memory_pool().release_unused()


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Let Python workers get rows in batches of ``BATCH_BYTES``, unless the session sets a bound of its own.

    The usual bound is a number of rows, so batches of long texts take tens of MB at both ends, in each task.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))
    return spark


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a job go when it ends; else they stay until the driver collects garbage.

    For steps that are written one after the other, and not run again from the same frame.
    """
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 2_048) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def steps(texts: pa.Array, size: int = 4_000_000) -> Iterator[pa.Array]:
    """Texts in parts of about ``size`` bytes, nulls as empty ones.

    Each part is copied to buffers of its own: some Arrow functions misread strings that begin inside a buffer.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    upto, begin = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // size, 0
    for end in [*(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]:
        if end > begin:
            yield texts.take(pa.array(np.arange(begin, end)))
        begin = end
