"""Rule checks over whole tables: accepted rows and a violations table.

A rule is a name, a condition that is true for a bad row, and a detail text.
All rules of a table run in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Mapping[str, tuple[Column, Column | str]]


def _found(rules: Rules) -> Column:
    entries = []
    for name, (bad, detail) in rules.items():
        text = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
        entries.append(
            F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("rule"), text.alias("detail")))
        )
    return F.array_compact(F.array(*entries))


def violations(df: DataFrame, row_id: str, rules: Rules) -> DataFrame:
    """(row_id, rule, detail), one row per broken rule; a NULL test counts as broken."""
    return df.select(
        F.col(row_id).cast("string").alias("row_id"), F.explode(_found(rules)).alias("_v")
    ).select("row_id", "_v.rule", "_v.detail")


def first_violation(rules: Rules) -> Column:
    """Name of the first broken rule in the given order, or NULL."""
    ladder = None
    for name, (bad, _) in rules.items():
        test = F.coalesce(bad, F.lit(True))
        ladder = F.when(test, name) if ladder is None else ladder.when(test, name)
    return ladder


def check(df: DataFrame, row_id: str, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, violations)."""
    accepted = df.filter(first_violation(rules).isNull())
    return accepted, violations(df, row_id, rules)


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def _orphans(df: DataFrame, id_col: str, ref: str, known: DataFrame, rule: str) -> DataFrame:
    ids = known.select(F.col("history_id").alias(ref))
    return df.join(ids, ref, "left_anti").select(
        F.col(id_col).cast("string").alias("row_id"),
        F.lit(rule).alias("rule"),
        F.col(ref).cast("string").alias("detail"),
    )


def _repeats(df: DataFrame, key: str, rule: str) -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(
            F.col(key).cast("string").alias("row_id"),
            F.lit(rule).alias("rule"),
            F.col("_n").cast("string").alias("detail"),
        )
    )


def _union(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def transition_integrity(transitions: DataFrame, histories: DataFrame) -> DataFrame:
    """Absent ends, ends of other trials or tasks, wrong order, missing operation or witness."""
    ends = histories.select("history_id", "task_id", "rollout_id", "step")

    def side(prefix: str) -> DataFrame:
        return ends.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ends.columns])

    known = transitions.join(
        side("s"), F.col("source_id") == F.col("s_history_id"), "inner"
    ).join(side("t"), F.col("target_id") == F.col("t_history_id"), "inner")
    rules = {
        "cross_rollout": (
            (F.col("s_rollout_id") != F.col("t_rollout_id")) | (F.col("s_task_id") != F.col("t_task_id")),
            F.col("target_id"),
        ),
        "step_not_increasing": (F.col("s_step") >= F.col("t_step"), F.col("target_id")),
        "empty_operation": (F.coalesce("operation", F.lit("")) == "", F.col("target_id")),
        "empty_witness": (F.coalesce("witness_ref", F.lit("")) == "", F.col("target_id")),
    }
    return _union(
        _orphans(transitions, "source_id", "source_id", histories, "absent_source"),
        _orphans(transitions, "source_id", "target_id", histories, "absent_target"),
        violations(known, "source_id", rules),
    )


def probe_integrity(probes: DataFrame, histories: DataFrame) -> DataFrame:
    """Absent histories, pairs within one task, equal ends, repeated probe ids."""
    tasks = histories.select("history_id", "task_id")
    left = tasks.select(F.col("history_id").alias("left_id"), F.col("task_id").alias("_left_task"))
    right = tasks.select(F.col("history_id").alias("right_id"), F.col("task_id").alias("_right_task"))
    known = probes.select("probe_id", "left_id", "right_id").join(left, "left_id").join(right, "right_id")
    rules = {
        "same_task": (F.col("_left_task") == F.col("_right_task"), F.col("_left_task")),
        "same_history": (F.col("left_id") == F.col("right_id"), F.col("left_id")),
    }
    return _union(
        _orphans(probes, "probe_id", "left_id", histories, "absent_left"),
        _orphans(probes, "probe_id", "right_id", histories, "absent_right"),
        violations(known, "probe_id", rules),
        _repeats(probes, "probe_id", "duplicate_probe"),
    )


def assignment_integrity(assignments: DataFrame, histories: DataFrame) -> DataFrame:
    """Histories without exactly one assignment and assignments without a history."""
    unassigned = histories.join(assignments.select("history_id"), "history_id", "left_anti")
    stray = assignments.join(histories.select("history_id"), "history_id", "left_anti")
    label = lambda df, rule: df.select(
        F.col("history_id").cast("string").alias("row_id"),
        F.lit(rule).alias("rule"),
        F.lit("").alias("detail"),
    )
    return _union(
        _repeats(histories, "history_id", "duplicate_history"),
        _repeats(assignments, "history_id", "duplicate_assignment"),
        label(unassigned, "unassigned_history"),
        label(stray, "assignment_without_history"),
    )


def priority_integrity(priority: DataFrame, tasks: DataFrame) -> DataFrame:
    """Priority entries that name no task or repeat one, and repeated tasks."""
    missing = priority.join(tasks.select("task_id"), "task_id", "left_anti").select(
        F.col("task_id").cast("string").alias("row_id"),
        F.lit("missing_task").alias("rule"),
        F.lit("").alias("detail"),
    )
    return _union(
        missing,
        _repeats(priority, "task_id", "duplicate_priority"),
        _repeats(tasks, "task_id", "duplicate_task"),
    )
