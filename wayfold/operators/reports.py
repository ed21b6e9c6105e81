"""Summaries of trials, usage, corpora and construction attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: longest reason text a report keeps.
REASON_LENGTH = 1_000


def trial_summary(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every trial with its number of calls; active ones have no result yet."""
    counted = calls.groupBy("rollout_id").agg(F.count(F.lit(1)).alias("policy_calls"))
    done = results.withColumn("completed", F.lit(True))
    rows = counted.join(done, "rollout_id", "full_outer")
    return rows.fillna({"policy_calls": 0, "completed": False})


def trial_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if("completed").alias("completed_trials"),
        F.count_if(~F.col("completed")).alias("active_trials"),
        F.sum(F.when(F.col("completed"), F.col("policy_calls"))).alias("completed_calls"),
        F.sum(F.when(~F.col("completed"), F.col("policy_calls"))).alias("active_calls"),
    )


def usage(calls: DataFrame) -> DataFrame:
    """Calls, cache hits and tokens per model and role; hits cost no tokens."""
    hit = F.col("cache_hit")
    return calls.groupBy("model", "role").agg(
        F.count_if(~hit).alias("calls"),
        F.count_if(hit).alias("cache_hits"),
        F.coalesce(F.sum(F.when(~hit, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(~hit, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
    )


def run_status(evaluated: Column, candidates: Column, train: Column, validation: Column) -> Column:
    """Label of a run: two candidates evaluated, and support in both splits."""
    return (
        F.when((evaluated < 2) | (candidates < 2), "incomplete: one candidate")
        .when((train > 0) & (validation > 0), "complete: support in both splits")
        .otherwise("complete: support missing in a split")
    )


def corpus_summary(
    histories: DataFrame, skipped: DataFrame, excluded: DataFrame, joint: DataFrame, board: DataFrame
) -> DataFrame:
    """One row: sizes of the corpus, ledgers and the status of the run.

    Tasks and rollouts are counted from one distinct list each.
    """
    sizes = histories.groupBy("task_id", "rollout_id").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("histories"),
        F.count_distinct("rollout_id").alias("rollouts"),
        F.count_distinct("task_id").alias("tasks"),
    )
    support = lambda split: joint.filter(F.col("split") == split).agg(
        F.coalesce(F.sum("supported"), F.lit(0))
    ).scalar()
    rows = (
        base.withColumn("skipped_trials", skipped.agg(F.count(F.lit(1))).scalar())
        .withColumn("excluded_trials", excluded.agg(F.count(F.lit(1))).scalar())
        .withColumn("supported_train", support("train"))
        .withColumn("supported_validation", support("validation"))
        .withColumn("candidates", board.agg(F.count(F.lit(1))).scalar())
        .withColumn("evaluated", board.agg(F.count_if(F.col("scored_probes") > 0)).scalar())
    )
    return rows.withColumn(
        "status",
        run_status(F.col("evaluated"), F.col("candidates"), F.col("supported_train"), F.col("supported_validation")),
    )


def attempt_ledger(runs: DataFrame) -> DataFrame:
    """(run, path_id, status, reason) of all attempts of many runs.

    ``runs``: run, attempted: array of struct(path_id, status, reason, error).
    """
    rows = runs.select("run", F.explode("attempted").alias("a"))
    reason = F.coalesce(F.col("a.reason"), F.col("a.error"), F.lit(""))
    return rows.select("run", "a.path_id", "a.status", F.substring(reason, 1, REASON_LENGTH).alias("reason"))


def attempt_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("run", "status").agg(F.count(F.lit(1)).alias("attempts"))
