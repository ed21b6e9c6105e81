"""Batch annotation: a caller's function over rows, cached, validated, retried.

The function gets a pandas frame of payload columns and returns one text per row.
It runs once per distinct request; an error it raises fails the job and is never
turned into a label.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.text import WINDOW_LIMIT, bounded_evidence, clipped
from wayfold.session import cut_lineage

BatchFunction = Callable[[pd.DataFrame], Sequence[str]]
Validator = Callable[[DataFrame], tuple[DataFrame, DataFrame]]

# Evidence budgets of the pair judge.
LOCAL_BUDGET, FULL_BUDGET = 18_000, 36_000


def request_key(payload: Sequence[str], model: str, options: str = "") -> Column:
    """Fingerprint of model, options and payload columns, in column order."""
    body = F.struct(F.lit(model).alias("model"), F.lit(options).alias("options"), *payload)
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def call(rows: DataFrame, payload: Sequence[str], fn: BatchFunction, partitions: int | None = None) -> DataFrame:
    """(request_key, response) for rows that carry request_key and the payload."""
    names = list(payload)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = list(fn(batch[names]))
            if len(answers) != len(batch):
                raise ValueError("the function must return one response per row")
            yield pd.DataFrame({"request_key": batch["request_key"].values, "response": answers})

    spread = rows.repartition(partitions, "request_key") if partitions else rows
    return spread.select("request_key", *names).mapInPandas(run, "request_key string, response string")


class AnswerCache:
    """Answers that outlive a run, in a folder bucketed on the request key.

    Every batch of new answers is appended as soon as it is there, so the next attempt, the next stage and the
    next run find it. Lookups and the removal of repeats (two writers may ask the same) happen inside the
    buckets: the stored answers are never shuffled. The folder alone is the cache; a new session names it anew.
    """

    COLUMNS = "request_key STRING, response STRING, written_at TIMESTAMP"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.name = "answers_" + hashlib.sha256(f"{self.root}|{buckets}".encode()).hexdigest()[:16]
        location = self.root.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (request_key) SORTED BY (request_key) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def entries(self) -> DataFrame:
        """(request_key, response), the first answer of each request."""
        rows = self.spark.table(self.name)
        return rows.groupBy("request_key").agg(F.min_by("response", F.struct("written_at", "response")).alias("response"))

    def add(self, fresh: DataFrame) -> None:
        """Appends answers; equal keys go to one file of their bucket per batch."""
        rows = fresh.select("request_key", "response", F.current_timestamp().alias("written_at"))
        rows.repartition(self.buckets, "request_key").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def batch(
    df: DataFrame,
    payload: Sequence[str],
    fn: BatchFunction,
    *,
    model: str,
    cache: DataFrame | AnswerCache | None = None,
    options: str = "",
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(df with request_key, response, cache_hit; new cache entries).

    Requests found in the cache (request_key, response) are reused; the others are
    computed once per distinct request. An ``AnswerCache`` takes the new answers at once; those of
    a table are the caller's to keep.
    """
    kept = cache if isinstance(cache, AnswerCache) else None
    cache = cache.entries() if kept else cache
    keyed = df.withColumn("request_key", request_key(payload, model, options))
    wanted = keyed.select("request_key", *payload).dropDuplicates(["request_key"])
    if cache is None:
        missing, known = wanted, None
    else:
        known = cache.select("request_key", "response")
        missing = wanted.join(known.select("request_key"), "request_key", "left_anti")
    fresh = cut_lineage(call(missing, payload, fn, partitions))
    if kept:
        # Read before the new answers are appended, so that their rows count as computed.
        known = cut_lineage(known.join(wanted.select("request_key"), "request_key", "left_semi"))
        if not fresh.isEmpty():
            kept.add(fresh)
    answers = fresh.withColumn("cache_hit", F.lit(False))
    if known is not None:
        answers = answers.unionByName(known.withColumn("cache_hit", F.lit(True)))
    return keyed.join(answers, "request_key"), fresh


def store(fresh: DataFrame, root: str) -> None:
    """Adds new entries to a cache folder, each batch in a folder of its own."""
    fresh.write.mode("errorifexists").parquet(f"{root}/batch={uuid.uuid4().hex}")


def load(spark: SparkSession, root: str) -> DataFrame:
    """Entries of a cache folder; equal requests of two writers count once."""
    rows = spark.read.schema("request_key string, response string, batch string").parquet(root)
    return rows.groupBy("request_key").agg(F.min_by("response", "batch").alias("response"))


def with_retry(
    df: DataFrame,
    row_id: str,
    payload: Sequence[str],
    fn: BatchFunction,
    validate: Validator,
    *,
    model: str,
    cache: DataFrame | AnswerCache | None = None,
    attempts: int = 2,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, attempt table, exhausted row ids).

    Every attempt is kept as accepted or rejected with its error. A later attempt
    sees the errors of the one before in the payload column ``feedback``.
    ``validate`` maps (row_id, response) rows to (accepted, violations). With an ``AnswerCache`` every
    attempt's answers are kept, so a second run with the same rows calls the function for none.
    """
    pending = df.withColumn("feedback", F.lit(""))
    columns = [*payload, "feedback"]
    accepted, history = None, None
    for attempt in range(attempts):
        answered, _ = batch(pending, columns, fn, model=model, cache=cache)
        answered = cut_lineage(answered)
        good, found = validate(answered.select(row_id, "response"))
        errors = found.groupBy("row_id").agg(
            F.concat_ws("; ", F.sort_array(F.collect_list(F.concat_ws(": ", "rule", "detail")))).alias("error")
        )
        judged = cut_lineage(
            answered.join(errors, answered[row_id].cast("string") == errors["row_id"], "left").drop("row_id")
        )
        log = judged.select(
            row_id,
            F.lit(attempt).alias("attempt"),
            F.when(F.col("error").isNull(), "accepted").otherwise("rejected").alias("status"),
            "error",
            "request_key",
            "response",
            "cache_hit",
        )
        history = log if history is None else history.unionByName(log)
        accepted = good if accepted is None else accepted.unionByName(good)
        rejected = judged.filter(F.col("error").isNotNull())
        pending = rejected.select(*df.columns, F.col("error").alias("feedback"))
        if pending.isEmpty():
            break
    return accepted, history, pending.select(row_id)


def receipts(df: DataFrame, row_id: str, prefix: str, attempts: DataFrame, instructions: str) -> DataFrame:
    """What each annotation rests on: one row per input row.

    (row_id, prefix_sha256, input_characters, input_clipped, instructions_sha256, attempts, answered, request_keys):
    the hash and size of the whole prefix, whether the reader saw only a window of it, the hash of the
    instructions, the number of attempts and whether the last was accepted, and the keys of the requests in order.
    """
    tries = attempts.groupBy(F.col(row_id).alias("_row")).agg(
        F.count(F.lit(1)).alias("attempts"), (F.max_by("status", "attempt") == "accepted").alias("answered"),
        F.transform(F.sort_array(F.collect_list(F.struct("attempt", "request_key"))), lambda t: t["request_key"]).alias("request_keys"),
    )
    rows = df.select(
        row_id, F.sha2(prefix, 256).alias("prefix_sha256"), F.length(prefix).cast("long").alias("input_characters"),
        clipped(prefix, WINDOW_LIMIT).alias("input_clipped"), F.sha2(F.lit(instructions), 256).alias("instructions_sha256"),
    )
    return rows.join(tries, F.col(row_id) == F.col("_row"), "left").drop("_row").fillna({"attempts": 0, "answered": False})


def technical_unknowns(exhausted: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Label ``unknown`` for rows that no attempt answered in form.

    Nothing is inferred: neither support nor contradiction.
    """
    text = F.lit("technical unknown: attempts exhausted, no judgment was obtained")
    return exhausted.select(
        "*",
        *[F.lit("unknown").alias(f"{n}_label") for n in labels],
        *[text.alias(f"{n}_rationale") for n in labels],
        F.lit(True).alias("technical_unknown"),
    )


def scope_downgrade(label: Column, clipped: Column) -> Column:
    """Support cannot rest on clipped evidence; the other labels stay."""
    return F.when(clipped & (label == "supported"), "unknown").otherwise(label)


def override_ledger(rows: DataFrame, row_id: str, claims: dict[str, str]) -> DataFrame:
    """Original labels that were lowered: one row per row and claim.

    ``claims`` maps a claim (its column is ``<claim>_label``) to its clipped flag.
    """
    entries = F.array(*[
        F.when(
            F.col(flag) & (F.col(f"{claim}_label") == "supported"),
            F.struct(F.lit(claim).alias("claim"), F.col(f"{claim}_label").alias("original_label")),
        )
        for claim, flag in claims.items()
    ])
    return rows.select(row_id, F.explode(F.array_compact(entries)).alias("_e")).select(row_id, "_e.*")


def judge_pairs(
    pairs: DataFrame,
    decide: BatchFunction,
    transfer: BatchFunction,
    *,
    model: str,
    decision_cache: DataFrame | AnswerCache | None = None,
    transfer_cache: DataFrame | AnswerCache | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(judged pairs, override ledger) of a two-stage judge.

    ``pairs``: probe_id, prefix_a, prefix_b, episodes (array of texts, in order).
    The first stage is given the two prefixes only, so it cannot see what
    followed. The second gets the first episode and all episodes, each bounded.
    """
    first, _ = batch(pairs, ["prefix_a", "prefix_b"], decide, model=model, cache=decision_cache)
    staged = first.select(
        *pairs.columns,
        F.get_json_object("response", "$.decision").alias("decision_label"),
    ).withColumn("_local", bounded_evidence(F.try_element_at("episodes", F.lit(1)), LOCAL_BUDGET)).withColumn(
        "_full", bounded_evidence(F.array_join("episodes", "\n"), FULL_BUDGET)
    )
    staged = staged.select(
        *[c for c in staged.columns if not c.startswith("_")],
        F.col("_local.data").alias("first_episode"),
        F.col("_local.clipped").alias("local_clipped"),
        F.col("_full.data").alias("all_episodes"),
        F.col("_full.clipped").alias("full_clipped"),
    )
    columns = ["prefix_a", "prefix_b", "decision_label", "first_episode", "all_episodes"]
    second, _ = batch(staged, columns, transfer, model=model, cache=transfer_cache)
    labelled = second.select(
        "probe_id", "decision_label", "local_clipped", "full_clipped",
        F.get_json_object("response", "$.local_transfer").alias("local_transfer_label"),
        F.get_json_object("response", "$.full_segment_transfer").alias("full_segment_transfer_label"),
    )
    claims = {"local_transfer": "local_clipped", "full_segment_transfer": "full_clipped"}
    overrides = override_ledger(labelled, "probe_id", claims)
    final = labelled.select(
        "probe_id",
        "decision_label",
        scope_downgrade(F.col("local_transfer_label"), F.col("local_clipped")).alias("local_transfer_label"),
        scope_downgrade(F.col("full_segment_transfer_label"), F.col("full_clipped")).alias("full_segment_transfer_label"),
        "local_clipped",
        "full_clipped",
    ).withColumn("splice_label", F.col("local_transfer_label"))
    return final, overrides


def classify(
    histories: DataFrame,
    candidate_ids: Sequence[str],
    fn: BatchFunction,
    *,
    model: str,
    cache: DataFrame | AnswerCache | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Every candidate's classifier over every history, with a per-pair cache.

    Only the prefix and its cutoff reach the function, next to the candidate id.
    """
    listed = F.array(*[F.lit(c) for c in candidate_ids])
    spread = histories.select("history_id", "prefix", F.col("step").alias("cutoff_step")).withColumn(
        "candidate_id", F.explode(listed)
    )
    answered, fresh = batch(spread, ["candidate_id", "prefix", "cutoff_step"], fn, model=model, cache=cache)
    return answered.select("candidate_id", "history_id", "response", "cache_hit"), fresh
