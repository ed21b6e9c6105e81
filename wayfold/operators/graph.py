"""Observed quotient graph: edges, nodes, memberships.

Edges keep counts and their first witness; the witnesses themselves stay rows,
so a popular edge never becomes one huge list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def witnesses(transitions: DataFrame, histories: DataFrame, assignments: DataFrame) -> DataFrame:
    """Transitions with task, state and bindings of both ends (states may be NULL)."""
    ends = histories.select("history_id", "task_id", "rollout_id", "step").join(
        assignments, "history_id", "left"
    )
    extra = [c for c in assignments.columns if c not in ("history_id", "state_id")]

    def side(prefix: str) -> DataFrame:
        return ends.select(
            F.col("history_id").alias(f"{prefix}_id"),
            F.col("state_id").alias(f"{prefix}_state"),
            *([F.col("task_id"), F.col("rollout_id")] if prefix == "source" else []),
            *[F.col(c).alias(f"{prefix}_{c}") for c in extra],
        )

    return transitions.join(side("source"), "source_id").join(side("target"), "target_id")


def assigned(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("source_state").isNotNull() & F.col("target_state").isNotNull())


def edges(rows: DataFrame) -> DataFrame:
    """One row per (source state, operation, target state)."""
    return (
        assigned(rows)
        .groupBy("source_state", "operation", "target_state")
        .agg(
            F.count(F.lit(1)).alias("witness_count"),
            F.min_by("source_id", F.struct("source_id", "target_id")).alias("first_source_id"),
            F.min_by("target_id", F.struct("source_id", "target_id")).alias("first_target_id"),
        )
    )


def stats(rows: DataFrame) -> DataFrame:
    """Transitions, and those with an unassigned end."""
    open_end = F.col("source_state").isNull() | F.col("target_state").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("transitions"),
        F.count_if(open_end).alias("unassigned_transitions"),
    )


def nodes(assignments: DataFrame) -> DataFrame:
    """Occupied states with their number of histories."""
    return (
        assignments.filter(F.col("state_id").isNotNull())
        .groupBy("state_id")
        .agg(F.count(F.lit(1)).alias("histories"))
    )


def build(histories: DataFrame, transitions: DataFrame, assignments: DataFrame):
    """(nodes, edges, stats, witness rows)."""
    rows = witnesses(transitions, histories, assignments)
    return nodes(assignments), edges(rows), stats(rows), assigned(rows)


def membership(members: DataFrame, edge_rows: DataFrame, definitions: DataFrame, outcomes: DataFrame):
    """Report per state: members, tasks, edges in and out, definition, outcome."""
    per_task = (
        members.filter(F.col("state_id").isNotNull())
        .groupBy("state_id", "task_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("state_id")
        .agg(F.sum("_n").alias("members"), F.count(F.lit(1)).alias("tasks"))
    )
    outgoing = edge_rows.groupBy(F.col("source_state").alias("state_id")).agg(
        F.count(F.lit(1)).alias("outgoing_edges")
    )
    incoming = edge_rows.groupBy(F.col("target_state").alias("state_id")).agg(
        F.count(F.lit(1)).alias("incoming_edges")
    )
    report = per_task
    for part in (outgoing, incoming, definitions, outcomes):
        report = report.join(part, "state_id", "left")
    return report.fillna(0, ["outgoing_edges", "incoming_edges"])
