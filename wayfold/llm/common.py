"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from wayfold.session import fresh_dir

STATE = "wayfold_worker_state"


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """One object per Python worker process, that of the key last asked for.

    Functions travel by value, so a module global would be fresh in every task; a
    tokenizer or a cache of words is worth keeping while the worker lives. Another key
    frees what the last operator kept.
    """
    holder = sys.modules.setdefault(STATE, types.ModuleType(STATE))
    if key not in holder.__dict__:
        for name in [n for n in holder.__dict__ if isinstance(n, tuple)]:
            del holder.__dict__[name]
        gc.collect()
        pa.default_memory_pool().release_unused()
        made = make()
        holder.__dict__[key] = made
    return holder.__dict__[key]


def by_size(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose values of ``column`` sum to about ``limit`` bytes.

    A single larger value makes a slice of its own.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which grows with the data on a tuned cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s:s+n] of all (s, n), one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(total)]


def kept(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Written to the shared folder and read again, so that no later step repeats the work."""
    path = fresh_dir(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
