"""Trial logs: policy calls, trial results and trajectory steps.

All schemas are explicit. Rows that do not parse keep their text in ``_corrupt``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions.json_values import first_values_of_lists, unfenced
from wayfold.functions.text import epoch
from wayfold.operators.ordering import positions

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
CALL_SCHEMA = T.StructType([
    T.StructField("schema", T.StringType()),
    T.StructField("trial_id", T.StringType()),
    T.StructField("call_index", T.LongType()),
    T.StructField("observed_at_epoch", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("prefix_sha256", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])
RESULT_SCHEMA = T.StructType([
    T.StructField("task_name", T.StringType()),
    T.StructField("config", T.StructType([
        T.StructField("task", T.StructType([T.StructField("path", T.StringType())])),
    ])),
    # Kept as text: reward maps mix numbers, booleans and strings.
    T.StructField("verifier_result", T.StructType([T.StructField("rewards", T.StringType())])),
    T.StructField("exception_info", T.StructType([
        T.StructField("exception_type", T.StringType()),
        T.StructField("exception_message", T.StringType()),
    ])),
    T.StructField("agent_result", T.StructType([
        T.StructField("n_input_tokens", T.LongType()),
        T.StructField("n_cache_tokens", T.LongType()),
        T.StructField("n_output_tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
    ])),
    T.StructField("_corrupt", T.StringType()),
])
STEP_SCHEMA = T.StructType([
    T.StructField("steps", T.ArrayType(T.StructType([
        T.StructField("step_id", T.LongType()),
        T.StructField("source", T.StringType()),
        # A variant, so that a message that is no text can be told from one.
        T.StructField("message", T.VariantType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("tool_calls", T.StringType()),
        T.StructField("observation", T.StructType([
            T.StructField("results", T.ArrayType(T.StructType([
                T.StructField("content", T.StringType()),
            ]))),
        ])),
    ]))),
    T.StructField("_corrupt", T.StringType()),
])
# Fixed value: text the harness returns for a response it could not parse.
PARSE_ERROR_TEXT = "Previous response had parsing errors"


def _below(root: str) -> str:
    return r"^(?:file:)?/*" + r"\Q" + root.removeprefix("file:").strip("/") + r"\E/+"


def _trial(root: str, tail: str) -> Column:
    """Trial folder relative to the root, from the file name."""
    name = F.regexp_replace(F.col("_metadata.file_path"), _below(root), "")
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), tail, "")


def _json(spark: SparkSession, root: str, schema: T.StructType, name: str, **options) -> DataFrame:
    reader = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.json(root)


def policy_calls(spark: SparkSession, root: str) -> DataFrame:
    """Every recorded call below root; the trial is its folder, blank lines vanish."""
    calls = _json(spark, root, CALL_SCHEMA, "policy_calls.jsonl")
    return calls.select(
        _trial(root, "/agent/policy_calls\\.jsonl$").alias("rollout_id"),
        "call_index",
        epoch("observed_at_epoch").alias("observed_at_epoch"),
        "messages",
        "prefix_sha256",
        "_corrupt",
    )


def first_reward(rewards: Column) -> Column:
    """Key ``reward`` if there is one, else the first number of the map.

    A map without any number has no reward. Booleans count as numbers.
    """
    entries = F.from_json(rewards, "map<string,variant>")
    kind = lambda v: F.schema_of_variant(v)
    as_number = lambda v: F.when(
        kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")
    ).otherwise(F.try_variant_get(v, "$", "double"))
    numeric = F.filter(
        F.map_values(entries),
        lambda v: kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"),
    )
    first = F.try_element_at(F.transform(numeric, as_number), F.lit(1))
    named = as_number(F.try_element_at(entries, F.lit("reward")))
    return F.when(
        F.size(numeric) > 0,
        F.when(F.map_contains_key(entries, "reward"), named).otherwise(first),
    )


def reward_of(rewards: Column, exception_type: Column) -> Column:
    """The reward, unless the verifier itself failed."""
    broken = F.lower(F.coalesce(exception_type, F.lit(""))).contains("verifier")
    return F.when(~broken, rewards)


def task_of(task_path: Column, task_name: Column, trial: Column) -> Column:
    """Last part of the task path, else the task name, else the trial name before ``__``."""
    trimmed = F.regexp_replace(task_path, "/+$", "")
    from_path = F.when(F.coalesce(trimmed, F.lit("")) != "", F.substring_index(trimmed, "/", -1))
    named = F.when(F.coalesce(task_name, F.lit("")) != "", task_name)
    leaf = F.substring_index(trial, "/", -1)
    return F.coalesce(from_path, named, F.substring_index(leaf, "__", 1))


def trial_results(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished trial with its reward, task, error and token usage."""
    results = _json(spark, root, RESULT_SCHEMA, "result.json", multiLine=True)
    trial = _trial(root, "/result\\.json$")
    rewards = F.col("verifier_result.rewards")
    error = F.col("exception_info.exception_type")
    return results.select(
        trial.alias("rollout_id"),
        task_of(F.col("config.task.path"), F.col("task_name"), trial).alias("task_id"),
        reward_of(first_reward(rewards), error).alias("reward"),
        rewards.alias("raw_rewards"),
        error.alias("error_type"),
        F.col("exception_info.exception_message").alias("error_message"),
        "agent_result.*",
        "_corrupt",
    )


#: JSON texts that count as nothing.
NOTHING = ("", "[]", "{}", "null", "false", "0", "0.0", '""')


def trajectories(spark: SparkSession, root: str) -> DataFrame:
    """One row per trial: its steps, in the shape ``trajectory_events`` reads."""
    docs = _json(spark, root, STEP_SCHEMA, "trajectory.json", multiLine=True)
    return read_steps(docs.withColumn("rollout_id", _trial(root, "/agent/trajectory\\.json$"))).select("rollout_id", "steps", "_corrupt")


def read_steps(docs: DataFrame) -> DataFrame:
    """Steps as recorded, in the shape ``trajectory_events`` reads.

    A message has commands if the JSON in it has: the text itself, inside a code fence, or the first complete
    list or object behind other words. Spark parses the messages that are JSON as a whole; the rest is
    scanned. A message that is no text is null.
    """
    text = lambda m: F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string"))
    clean = docs.withColumn("_texts", F.transform("steps", lambda s: text(s["message"]))).withColumn(
        "_clean", F.transform("_texts", unfenced)
    ).withColumn("_whole", F.transform("_clean", F.try_parse_json))
    unread = F.zip_with("_clean", "_whole", lambda c, w: F.when(w.isNull(), c))
    spans = clean.withColumn("_spans", first_values_of_lists(unread))

    def reshape(step: Column, k: Column) -> Column:
        value = F.coalesce(F.get(F.col("_whole"), k), F.try_parse_json(F.get(F.col("_spans"), k)))
        listed = F.coalesce(F.to_json(F.try_variant_get(value, "$.commands", "variant")), F.lit(""))
        tools = F.coalesce(step["tool_calls"], F.lit(""))
        return F.struct(
            step["step_id"].alias("step_id"),
            step["source"].alias("source"),
            F.get(F.col("_texts"), k).alias("message"),
            F.coalesce(
                F.transform(step["observation"]["results"], lambda r: F.coalesce(r["content"], F.lit(""))),
                F.array().cast("array<string>"),
            ).alias("observations"),
            (~listed.isin(*NOTHING) | ~tools.isin(*NOTHING)).alias("has_commands"),
            step["timestamp"].alias("timestamp"),
        )

    return spans.withColumn("steps", F.transform("steps", reshape)).drop("_texts", "_clean", "_whole", "_spans")


def event_status(observations: Column, has_commands: Column) -> Column:
    """First match wins: parse error, no feedback, executed, recorded only."""
    return (
        F.when(F.exists(observations, lambda o: o.contains(PARSE_ERROR_TEXT)), "rejected_parse_response")
        .when(F.size(observations) == 0, "unconfirmed_no_observation")
        .when(has_commands, "execution_episode")
        .otherwise("recorded_noop_or_completion")
    )


def agent_steps(steps: Column) -> Column:
    """Agent steps with a text message, in order, with status and epoch."""
    kept = F.filter(steps, lambda s: (s["source"] == "agent") & s["message"].isNotNull())
    return F.transform(
        kept,
        lambda s, i: F.struct(
            i.cast("long").alias("occurrence"),
            s["step_id"].alias("step_id"),
            s["message"].alias("message"),
            s["observations"].alias("observations"),
            event_status(s["observations"], s["has_commands"]).alias("status"),
            epoch(s["timestamp"]).alias("timestamp_epoch"),
        ),
    )


def trajectory_events(trajectories: DataFrame) -> DataFrame:
    """Nested events per trial (one row per trial, order kept)."""
    return trajectories.select("rollout_id", agent_steps(F.col("steps")).alias("events"))


def flat_events(steps: DataFrame) -> DataFrame:
    """Event rows from a flat step table, numbered per trial from 0."""
    kept = steps.filter((F.col("source") == "agent") & F.col("message").isNotNull())
    numbered = positions(kept, ["rollout_id"], "step_id")
    observed = F.when(F.col("observation").isNull(), F.array().cast("array<string>")).otherwise(
        F.array("observation")
    )
    return numbered.select(
        "rollout_id",
        "step_id",
        F.col("pos").alias("occurrence"),
        event_status(observed, F.col("has_commands")).alias("status"),
        "message",
        "observation",
    )


def split_completed(calls: DataFrame, results: DataFrame, excluded: DataFrame | None = None):
    """(kept calls, skipped ledger, exclusion ledger).

    Trials without a result are ledgered as not completed; trials of excluded
    tasks get an audit row. Both tests run on the narrow results table before any
    call row is parsed further.
    """
    excluded_trials = None
    eligible = results
    if excluded is not None:
        excluded_trials = results.join(excluded, "task_id").select(
            "rollout_id",
            "task_id",
            "reason",
            F.lit(True).alias("raw_rollout_retained"),
            F.lit(False).alias("selection_uses_terminal_reward"),
        )
        eligible = results.join(excluded.select("task_id"), "task_id", "left_anti")
    skipped = (
        calls.select("rollout_id")
        .distinct()
        .join(results.select("rollout_id"), "rollout_id", "left_anti")
        .withColumn("reason", F.lit("not_completed"))
    )
    kept = calls.join(eligible.select("rollout_id"), "rollout_id", "left_semi")
    return kept, skipped, excluded_trials


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of every key by ``order`` within bounded groups."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n <= 1").drop("_n")
