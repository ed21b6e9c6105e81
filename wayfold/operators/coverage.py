"""What the recorded prefixes leave out of every trial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.segments import UNMATCHED, readable_events, with_alignment


def last_calls(calls: DataFrame) -> DataFrame:
    """Last call of every trial and the number of calls, as one aggregate."""
    stats = calls.groupBy("rollout_id").agg(
        F.max("call_index").alias("call_index"), F.count(F.lit(1)).alias("recorded_policy_calls")
    )
    return calls.join(stats, ["rollout_id", "call_index"])


def report(calls: DataFrame, events: DataFrame) -> DataFrame:
    """One row per trial: call count, unaligned occurrences and the omitted tail.

    With a cutoff and a timestamp on every event the tail is bounded by time;
    otherwise it follows the last visible event, and is unknown when the
    trajectory is missing or something visible did not align.
    """
    return tails(last_calls(calls), events)


def tails(last: DataFrame, events: DataFrame) -> DataFrame:
    """``report`` from the last call of every trial, with its messages and ``recorded_policy_calls``."""
    final = last.select("rollout_id", "call_index", "recorded_policy_calls", "messages", "observed_at_epoch")
    aligned = with_alignment(final.join(readable_events(events), "rollout_id", "left"))
    listed = F.coalesce(F.col("events"), F.array().cast(events.schema["events"].dataType))
    base = aligned.withColumn("_events", listed).withColumn(
        "_last", F.coalesce(F.array_max(F.transform("aligned", lambda e: e["occurrence"])), F.lit(-1))
    )
    cutoff = F.col("observed_at_epoch")
    timed = (
        cutoff.isNotNull()
        & (F.size("_events") > 0)
        & F.forall("_events", lambda e: e["timestamp_epoch"].isNotNull())
    )
    by_time = F.filter("_events", lambda e: e["timestamp_epoch"] > cutoff)
    by_order = F.filter("_events", lambda e: e["occurrence"] > F.col("_last"))
    unaligned = F.size(F.filter("aligned", lambda e: e["status"] == UNMATCHED))
    unknown = F.col("events").isNull() | (unaligned > 0)
    tail = base.withColumn("_tail", F.when(timed, by_time).otherwise(by_order)).withColumn(
        "terminal_response_omitted",
        F.when(timed | ~unknown, F.size("_tail") > 0),
    )
    omitted = F.col("terminal_response_omitted")
    ids = lambda rows: F.concat_ws(
        ",", F.transform(rows, lambda e: e["step_id"].cast("string"))
    )
    return tail.select(
        "rollout_id",
        "recorded_policy_calls",
        F.col("call_index").alias("last_prefix_call_index"),
        F.size("_events").cast("long").alias("trajectory_agent_occurrences"),
        unaligned.cast("long").alias("unaligned_visible_occurrences"),
        ids(F.col("_tail")).alias("terminal_tail_step_ids"),
        ids(F.filter("_tail", lambda e: e["status"] == "execution_episode")).alias(
            "terminal_tail_execution_step_ids"
        ),
        omitted,
        # The labels of the published coverage report.
        F.when(timed, "timestamp_bounded_tail_after_final_prefix")
        .when(unknown, "uncertain_missing_trajectory_or_unmatched_visible_occurrences")
        .otherwise("ordered_tail_after_final_prefix_occurrences")
        .alias("tail_evidence_status"),
        F.when(omitted.isNull(), "terminal tail unknown")
        .when(omitted, "prefix_graph_excludes_terminal_response_tail")
        .otherwise("no_additional_recorded_tail; terminal coverage not independently established")
        .alias("coverage_label"),
    )
