"""Vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def pack(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(id, vector, more...): usable vectors as the bytes of their components in double precision.

    Vectors of different lengths have different bytes; only those of the most frequent length
    are comparable, so others are left out by the operators that meet several lengths.
    """
    rows = df.filter(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *more
    )

    def run(batches):
        for batch in batches:
            packed = [np.asarray(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(packed, pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", *more])

    kinds = dict(rows.dtypes)
    extra = "".join(f", {m} {kinds[m]}" for m in more)
    return rows.mapInArrow(run, f"id long, vector binary{extra}")


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of packed vectors of one length."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.zeros((0, 0))
