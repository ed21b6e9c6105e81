"""Outcomes pooled per state, attached only after grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool(visits: DataFrame, rewards: DataFrame) -> DataFrame:
    """One vote per (state, rollout); only rewards of exactly 0 or 1 are graded.

    ``visits`` has state_id, rollout_id, task_id; ``rewards`` rollout_id, reward.
    The state totals are summed from per-task totals, so a popular state is
    combined before it is shuffled.
    """
    votes = (
        visits.filter(F.col("state_id").isNotNull())
        .select("state_id", "rollout_id", "task_id")
        .distinct()
        .join(rewards.select("rollout_id", "reward"), "rollout_id", "left")
    )
    graded = F.col("reward").isin(0.0, 1.0)
    per_task = votes.groupBy("state_id", "task_id").agg(
        F.count(F.lit(1)).alias("_rollouts"),
        F.count_if(graded).alias("_graded"),
        F.sum(F.when(graded, F.col("reward"))).alias("_wins"),
    )
    pooled = per_task.groupBy("state_id").agg(
        F.sum("_rollouts").alias("distinct_rollouts"),
        F.sum("_graded").alias("graded_rollouts"),
        F.count(F.lit(1)).alias("distinct_tasks"),
        F.sum("_wins").alias("_wins"),
    )
    rate = F.when(F.col("graded_rollouts") > 0, F.col("_wins") / F.col("graded_rollouts"))
    return (
        pooled.withColumn("pooled_success_rate", rate)
        .withColumn(
            "pooled_binary_variance",
            F.col("pooled_success_rate") * (1 - F.col("pooled_success_rate")),
        )
        .drop("_wins")
    )


def ranked(pooled: DataFrame) -> DataFrame:
    """Most mixed outcomes first, then most rollouts."""
    return pooled.orderBy(
        F.coalesce("pooled_binary_variance", F.lit(0.0)).desc(),
        F.col("distinct_rollouts").desc(),
        "state_id",
    )
