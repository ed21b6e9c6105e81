"""Views that give the driver's tables the shape of trial logs.

Every view is one SELECT that Spark and DuckDB read alike, so a query and its
check start from the same rows. The nested records (message lists, trajectory
steps) are built on the Spark side only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import anchors
from wayfold.session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables with long texts, where the work per row is large.
TEXT_TABLES = ("documents", "conversations", "pages")

# name -> (views it reads, SELECT text); names in braces are tables or views.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "trial_calls": (
        (),
        """SELECT user_id AS rollout_id, concat('task-', CAST(user_id % 6 AS STRING)) AS task_id,
        event_id AS call_index, concat(CAST(user_id AS STRING), '/h', CAST(event_id AS STRING)) AS history_id,
        ts, event_type AS operation, value,
        CASE WHEN value < 5 THEN NULL WHEN value < 35 THEN concat(event_type, '-lo')
             ELSE concat(event_type, '-hi') END AS state_id
        FROM {events}""",
    ),
    "trial_results": (
        (),
        """SELECT user_id AS rollout_id, concat('task-', CAST(user_id % 6 AS STRING)) AS task_id,
        CASE WHEN user_id % 10 = 0 THEN NULL
             WHEN max_by(event_type, ts) IN ('purchase', 'signup') THEN 1.0E0 ELSE 0.0E0 END AS reward
        FROM {events} WHERE user_id % 25 <> 3 GROUP BY user_id""",
    ),
    "conv_turns": (
        (),
        """SELECT conv_id AS rollout_id,
        concat('task-', CAST(conv_id % 6 AS STRING)) AS task_id, conv_id, turn, role, text
        FROM {conversations}""",
    ),
    "conv_calls": (
        ("conv_turns",),
        """SELECT rollout_id, task_id, conv_id, turn AS call_index, text AS response
        FROM {conv_turns} WHERE role = 'assistant'""",
    ),
    # For the checks: the anchor calls, of which alone the prefixes are laid out.
    "conv_anchors": (
        ("conv_calls",),
        """SELECT * FROM (SELECT c.*,
            row_number() OVER (PARTITION BY rollout_id ORDER BY call_index) - 1 AS pos,
            count(*) OVER (PARTITION BY rollout_id) AS n FROM {conv_calls} c) x
        WHERE n <= 6 OR pos IN (0, round_even((n - 1) / 5.0, 0), round_even(2 * (n - 1) / 5.0, 0),
            round_even(3 * (n - 1) / 5.0, 0), round_even(4 * (n - 1) / 5.0, 0), n - 1)""",
    ),
    "trajectory_steps": (
        ("conv_calls", "conv_turns"),
        """SELECT c.rollout_id, c.task_id, c.call_index AS step_id, 'agent' AS source, c.response AS message,
        CASE WHEN c.rollout_id % 7 = 0 AND c.call_index < 3 THEN 'Previous response had parsing errors'
             WHEN c.rollout_id % 4 = 0 AND c.call_index < 2 THEN NULL ELSE n.text END AS observation,
        c.rollout_id % 5 <> 0 AS has_commands
        FROM {conv_calls} c LEFT JOIN {conv_turns} n ON n.rollout_id = c.rollout_id AND n.turn = c.call_index + 1""",
    ),
    "histories": (
        (),
        """SELECT d.doc_id AS history_id, d.source AS task_id, d.doc_id AS rollout_id, CAST(0 AS INT) AS step,
        d.text AS prefix, l.doc_id IS NOT NULL AS has_segment
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    ),
    "probes": (
        (),
        """SELECT concat(CASE WHEN l.doc_id % 4 = 0 THEN 'validation-' ELSE 'train-' END, CAST(l.doc_id AS STRING)) AS probe_id,
        l.doc_id AS left_id, r.doc_id AS right_id, a.source AS left_task, r.source AS right_task,
        CASE WHEN l.doc_id % 13 = 0 THEN 'unknown' WHEN l.quality = 1 THEN 'supported' ELSE 'contradicted' END AS decision_label,
        CASE WHEN r.doc_id % 9 = 0 THEN 'unknown' WHEN l.toxic = 1 THEN 'contradicted' ELSE 'supported' END AS splice_label,
        CASE WHEN l.doc_id % 8 = 5 THEN 'unknown' WHEN l.doc_id % 8 = 6 THEN 'contradicted' ELSE 'supported' END AS full_label,
        CASE l.doc_id % 5 WHEN 0 THEN 'execution' WHEN 1 THEN 'programmatic' WHEN 2 THEN 'human' WHEN 3 THEN 'llm' ELSE 'synthetic' END AS method,
        l.doc_id % 7 <> 0 AS independent, l.doc_id % 3 = 0 AS audited
        FROM {labels} l JOIN {documents} a ON a.doc_id = l.doc_id
        JOIN {documents} r ON r.doc_id = l.doc_id + 1""",
    ),
    "probes_cross": (
        ("probes",),
        """SELECT * FROM {probes} WHERE left_task <> right_task""",
    ),
    "candidate_assignments": (
        (),
        """SELECT concat('c', CAST(k AS STRING)) AS candidate_id, k AS candidate_index, doc_id AS history_id,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('S', CAST(n_chars % k AS STRING)) END AS state_id
        FROM (SELECT doc_id, n_chars, explode_k AS k FROM (
            SELECT doc_id, n_chars, 2 AS explode_k FROM {documents}
            UNION ALL SELECT doc_id, n_chars, 4 FROM {documents}
            UNION ALL SELECT doc_id, n_chars, 8 FROM {documents}) e) x""",
    ),
    "usage_calls": (
        (),
        """SELECT event_id AS call_id, event_type AS role, concat('model-', CAST(user_id % 3 AS STRING)) AS model,
        value < 20 AS cache_hit, CAST(round(value * 100) AS BIGINT) AS input_tokens,
        CAST(round(value) AS BIGINT) AS output_tokens FROM {events}""",
    ),
    # The same anchors and transitions that the operators make, for the checks.
    "anchor_rows": (
        ("trial_calls",),
        """SELECT * FROM (SELECT c.*,
            row_number() OVER (PARTITION BY rollout_id ORDER BY call_index) - 1 AS pos,
            count(*) OVER (PARTITION BY rollout_id) AS n FROM {trial_calls} c) x
        WHERE n <= 6 OR pos IN (0, round_even((n - 1) / 5.0, 0), round_even(2 * (n - 1) / 5.0, 0),
            round_even(3 * (n - 1) / 5.0, 0), round_even(4 * (n - 1) / 5.0, 0), n - 1)""",
    ),
    "transition_rows": (
        ("anchor_rows",),
        """SELECT * FROM (SELECT rollout_id, task_id, history_id AS source_id,
            lead(history_id) OVER w AS target_id, operation, state_id AS source_state,
            lead(state_id) OVER w AS target_state, call_index AS start_step, lead(call_index) OVER w AS end_step
            FROM {anchor_rows} WINDOW w AS (PARTITION BY rollout_id ORDER BY call_index)) x
        WHERE target_id IS NOT NULL""",
    ),
    "anchor_places": (
        ("anchor_rows",),
        """SELECT rollout_id, task_id, history_id, state_id, call_index,
        row_number() OVER (PARTITION BY rollout_id ORDER BY call_index) - 1 AS place FROM {anchor_rows}""",
    ),
    # Judged pairs of anchors at the same place of neighbouring trials.
    "anchor_probes": (
        ("anchor_places",),
        """SELECT concat(CASE WHEN l.rollout_id % 4 = 0 THEN 'validation-' ELSE 'train-' END,
            CAST(l.rollout_id AS STRING), '-', CAST(l.place AS STRING)) AS probe_id,
        l.history_id AS left_id, r.history_id AS right_id, l.task_id AS left_task, r.task_id AS right_task, l.place,
        CASE WHEN (l.rollout_id + l.place) % 7 = 3 THEN 'contradicted' WHEN (l.rollout_id + l.place) % 7 = 4 THEN 'unknown' ELSE 'supported' END AS decision_label,
        CASE WHEN l.rollout_id % 9 = 2 THEN 'contradicted' ELSE 'supported' END AS local_label,
        CASE WHEN l.rollout_id % 3 = 1 THEN NULL WHEN l.rollout_id % 5 = 2 THEN 'contradicted' ELSE 'supported' END AS full_label,
        CASE WHEN l.rollout_id % 4 = 1 THEN 'execution' ELSE 'llm' END AS method, l.rollout_id % 11 <> 5 AS independent,
        l.rollout_id % 2 = 1 AS audited,
        CASE WHEN l.rollout_id % 2 = 0 THEN 'full_observed_segment' ELSE 'first_witnessed_execution_episode' END AS operation_scope
        FROM {anchor_places} l JOIN {anchor_places} r ON r.rollout_id = l.rollout_id + 1 AND r.place = l.place""",
    ),
}


def needed(*names: str) -> list[str]:
    """Views in dependency order."""
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in seen:
            for dep in VIEWS[name][0]:
                visit(dep)
            seen.append(name)

    for name in names:
        visit(name)
    return seen


def check_sql(body: str, *views: str, **ctes: str) -> str:
    """DuckDB text: the views the check reads, extra CTEs in order, then the body.

    CTEs whose name starts with ``walk`` may refer to themselves.
    """
    names = {n: n for n in (*TABLES, *VIEWS)}
    parts = [f"{name} AS ({VIEWS[name][1].format(**names)})" for name in needed(*views)]
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    keyword = "WITH RECURSIVE " if any(name.startswith("walk") for name in ctes) else "WITH "
    return (keyword + ",\n".join(parts) + "\n" if parts else "") + body


class Views:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                if name in TEXT_TABLES:
                    made = spread(made)
            elif name == "anchor_rows":
                made = self.chosen_anchors.withColumnRenamed("recorded_calls", "n")
            else:
                deps, text = VIEWS[name]
                reads = {n: self[n] for n in (*TABLES, *deps) if "{" + n + "}" in text}
                made = self.spark.sql(text, **reads)
            self._made[name] = made
        return self._made[name]

    @cached_property
    def chosen_anchors(self) -> DataFrame:
        """The anchor calls of every trial, numbered once for all branches of a query."""
        return anchors.select(self["trial_calls"])

    def with_prefixes(self, calls: DataFrame) -> DataFrame:
        """Call rows with the whole message list before each; ``calls`` are few per trial."""
        turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
        earlier = F.col("turn") < F.col("_call")
        lists = (
            calls.select("rollout_id", F.col("call_index").alias("_call"))
            .join(self["conv_turns"], "rollout_id").filter(earlier)
            .groupBy("rollout_id", F.col("_call").alias("call_index")).agg(F.sort_array(F.collect_list(turn)).alias("_m"))
        )
        said = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
        return calls.join(lists, ["rollout_id", "call_index"], "left").select(
            F.col("rollout_id").cast("string").alias("rollout_id"),
            *[c for c in calls.columns if c != "rollout_id"],
            F.coalesce(said, F.array().cast("array<struct<role:string,content:string>>")).alias("messages"),
            F.lit(None).cast("double").alias("observed_at_epoch"),
            F.lit(None).cast("string").alias("prefix_sha256"),
        )

    @cached_property
    def anchor_records(self) -> DataFrame:
        """The anchor calls of every conversation with their prefixes."""
        chosen = anchors.select(self["conv_calls"].select("rollout_id", "task_id", "call_index"))
        return self.with_prefixes(chosen.drop("pos", "recorded_calls"))

    @cached_property
    def trajectories(self) -> DataFrame:
        """One row per trial with its step list."""
        step = F.struct(
            F.col("step_id"),
            F.col("source"),
            F.col("message"),
            F.when(F.col("observation").isNotNull(), F.array("observation"))
            .otherwise(F.array().cast("array<string>"))
            .alias("observations"),
            F.col("has_commands"),
            F.lit(None).cast("string").alias("timestamp"),
        )
        return self["trajectory_steps"].groupBy(
            F.col("rollout_id").cast("string").alias("rollout_id")
        ).agg(F.sort_array(F.collect_list(step)).alias("steps"))
