"""Anchor prefixes: evenly spaced calls of every trial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import fingerprint
from wayfold.operators.ordering import positions
from wayfold.sources.logs import first_seen


def quantile_places(n: Column, k: int) -> Column:
    """Places 0..n-1 of k evenly spaced rows, halves rounded to even."""
    even = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.bround(i * (n - 1) / F.lit(float(k - 1))).cast("long"),
    )
    return F.array_distinct(even)


def is_anchor(pos: Column, n: Column, k: int) -> Column:
    return (n <= k) | F.array_contains(quantile_places(n, k), pos)


def select(
    calls: DataFrame, k: int = 6, *, key: str = "rollout_id", order: str = "call_index"
) -> DataFrame:
    """Anchor calls of every trial, all of them in trials of at most k calls.

    Only the two key columns are sorted; the wide call rows are fetched for the
    chosen keys afterwards.
    """
    placed = positions(calls.select(key, order), [key], order)
    chosen = placed.filter(is_anchor(F.col("pos"), F.col("group_rows"), k)).select(
        key, order, "pos", F.col("group_rows").alias("recorded_calls")
    )
    return calls.join(chosen, [key, order])


def dedupe(anchors: DataFrame, *, key: str = "rollout_id", order: str = "call_index") -> DataFrame:
    """First anchor of every (trial, prefix); equal later prefixes add no evidence."""
    if "prefix_key" in anchors.columns:
        keyed = anchors
    else:
        keyed = anchors.withColumn(
            "prefix_key", F.coalesce("prefix_sha256", fingerprint("messages"))
        )
    return first_seen(keyed, [key, "prefix_key"], order)


def history_id(rollout: Column | str, call_index: Column | str) -> Column:
    """Trial id, ``/h`` and the call index with at least three digits."""
    rollout = F.col(rollout) if isinstance(rollout, str) else rollout
    call_index = F.col(call_index) if isinstance(call_index, str) else call_index
    return F.format_string("%s/h%03d", rollout.cast("string"), call_index.cast("long"))


def prefix_records(calls: DataFrame, k: int = 6) -> DataFrame:
    """History records: anchors of every trial without repeated prefixes."""
    return dedupe(select(calls, k)).select(
        history_id("rollout_id", "call_index").alias("history_id"),
        "task_id",
        "rollout_id",
        F.col("call_index").alias("step"),
        "messages",
        "observed_at_epoch",
        F.col("prefix_key").alias("prefix_sha256"),
    )
