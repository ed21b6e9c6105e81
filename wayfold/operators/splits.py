"""Splits by whole group, and disjointness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import seeded_rank_key
from wayfold.operators.ordering import positions


def validation_size(n: Column, fraction: float = 0.25) -> Column:
    """At least two groups on each side, the fraction rounded half to even."""
    return F.greatest(F.lit(2), F.least(n - 2, F.bround(n * F.lit(fraction)).cast("long")))


def by_group(
    df: DataFrame, seed: int, *, group: str = "task_id", fraction: float = 0.25
) -> DataFrame:
    """(group, split) for every distinct group; whole groups go to one side.

    The order is a seeded hash, so the place of a group is the number of groups
    with a smaller hash. The place is found on hash buckets, which keeps the
    numbering off a single task.
    """
    key = seeded_rank_key(seed, group)
    groups = df.select(group).distinct().withColumn("_key", key)
    bucketed = groups.withColumn("_slot", F.conv(F.substring("_key", 1, 4), 16, 10).cast("long"))
    placed = positions(bucketed, [], "_slot", ["_key"])
    n = F.col("group_rows")
    size = F.when(n >= 4, validation_size(n, fraction)).otherwise(
        F.raise_error(F.lit("a split needs at least four groups"))
    )
    return placed.select(
        group, F.when(F.col("pos") < size, "validation").otherwise("train").alias("split")
    )


def hygiene(exposed: DataFrame, held_out: DataFrame) -> DataFrame:
    """Flags of disjointness by task and by family.

    Family names stay marked unvalidated: they are a heuristic, not a guarantee.
    """
    shared = lambda key: exposed.select(key).distinct().intersect(
        held_out.select(key).distinct()
    )
    tasks = shared("task_id").agg(F.count(F.lit(1)).alias("shared_tasks"))
    families = shared("family").agg(F.count(F.lit(1))).scalar()
    return tasks.withColumn("shared_families", families).select(
        "shared_tasks",
        "shared_families",
        (F.col("shared_tasks") == 0).alias("task_disjoint"),
        (F.col("shared_families") == 0).alias("family_disjoint"),
        F.lit(False).alias("validated_family_disjoint"),
        F.lit(True).alias("family_audit_required"),
    )
