"""Streaming ingest of calls and the live monitor of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def call_stream(
    spark: SparkSession, root: str, schema: T.StructType, *, glob: str | None = None, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Calls appended as files below a folder."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def without_repeats(
    calls: DataFrame, *, time: str = "ts", delay: str = "1 hour", keys=("rollout_id", "prefix_sha256")
) -> DataFrame:
    """First call of every trial and prefix inside the watermark.

    State is kept per key and dropped when the watermark passes it; rows later
    than the watermark are dropped.
    """
    return calls.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def activity(calls: DataFrame, *, time: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Calls and last activity per trial and tumbling window of event time."""
    return (
        calls.withWatermark(time, delay)
        .groupBy(F.window(time, window), "rollout_id")
        .agg(F.count(F.lit(1)).alias("calls"), F.max(time).alias("last_activity"))
        .select(
            "rollout_id",
            F.col("window.start").alias("window_start"),
            "calls",
            "last_activity",
        )
    )


def with_status(activity_rows: DataFrame, results: DataFrame) -> DataFrame:
    """Marks trials without a result as active (stream-static join)."""
    done = results.select("rollout_id", F.lit(True).alias("_done"))
    return activity_rows.join(done, "rollout_id", "left").select(
        *activity_rows.columns, F.col("_done").isNull().alias("active")
    )


def with_results(
    calls: DataFrame, results: DataFrame, *, time: str = "ts", finished: str = "finished_at", within: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Every call with its trial's result, both arriving as streams (rollout_id, ``time``, call columns, ``finished``, active).

    An outer join of two watermarked streams: a result counts for calls up to ``within`` before it. A call whose
    result arrives in a later file is given out as done when it does; one whose time has passed without a result is
    given out as active. Calls wait in the state until then, and results later than the watermark are dropped.
    """
    left = calls.withWatermark(time, delay)
    right = results.select(F.col("rollout_id").alias("_trial"), finished).withWatermark(finished, delay)
    match = (
        (F.col("rollout_id") == F.col("_trial")) & (F.col(finished) >= F.col(time))
        & (F.col(finished) <= F.col(time) + F.expr(f"INTERVAL {within}"))
    )
    return left.join(right, match, "left_outer").select(*calls.columns, finished, F.col(finished).isNull().alias("active"))


def append_to(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends finished rows as parquet; stops when the input is read."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_to(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes changed rows per batch into its own folder.

    The folder is replaced when a batch is replayed, so a retry adds no rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Last version of every row that ``upsert_to`` wrote."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
