"""Positions and bounded prefixes of ordered groups.

Both helpers keep one very large group off a single task: positions are numbered
range by range, and ranked prefixes filter on ``row_number`` so that Spark keeps
only the needed rows per group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.session import cut_lineage


def positions(
    df: DataFrame,
    keys: Sequence[str],
    slice_on: str,
    ties: Sequence[str] = (),
    *,
    slices: int | None = None,
) -> DataFrame:
    """Adds ``pos`` (0-based place in its group) and ``group_rows``.

    Rows are dealt into ``slices`` ranges of (keys, slice_on, ties) whose bounds Spark
    samples from the data, so a large group fills several ranges. Each range is
    numbered by itself and shifted by the rows of its group in earlier ranges. Nulls
    come first, null keys form a group, and any orderable type will do. The dealt rows
    are checkpointed, since both branches below must see the same bounds.
    """
    keys, order = list(keys), [slice_on, *ties]
    ranges = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *[F.col(c) for c in (*keys, *order)])
    rows = cut_lineage(dealt.withColumn("_slice", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per key and range, so the window over all ranges stays small.
    offsets = (
        rows.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(k).alias(f"_of_{k}") for k in keys],
            F.col("_slice").alias("_of_slice"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(group).alias("group_rows"),
        )
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = rows.withColumn("_local", F.row_number().over(local))
    match = F.col("_slice") == F.col("_of_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return numbered.join(offsets, match).select(
        *df.columns, (F.col("_before") + F.col("_local") - 1).cast("long").alias("pos"), "group_rows"
    )


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all rows before this one in ``order``, which must be unique.

    As in ``positions``, rows are dealt into sampled ranges, summed range by range and shifted.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *[F.col(c) for c in order])
    rows = cut_lineage(dealt.withColumn("_slice", F.spark_partition_id()))
    # One row per range, so this window stays small.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_slice").agg(F.sum(value).alias("_n"))
    offsets = sums.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    return summed.join(offsets, "_slice").select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every group; the cut happens before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def first_rows_mixed(
    df: DataFrame, keys: Sequence[str], kind: str, order: Sequence[Column], n: int
) -> DataFrame:
    """Enough of each group to hold its first n rows outside any one kind.

    Every kind keeps its first n rows and the group then its first 2n, so leaving
    out one kind always leaves the n best of the others.
    """
    capped = first_rows(df, [*keys, kind], order, n)
    return first_rows(capped, keys, order, 2 * n)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The least row of every group by ``order``, as a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("_row")).select(
        *keys, "_row.*"
    )
