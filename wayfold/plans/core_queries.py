"""Queries: sources, anchors, segments, graph and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import anchors, coverage, graph, outcomes, segments
from wayfold.plans.fixtures import Views, check_sql
from wayfold.plans.registry import query
from wayfold.session import fresh_dir
from wayfold.sources import artifacts, logs


@query(
    "log_calls_in_order",
    check_sql(
        "SELECT rollout_id, call_index, row_number() OVER (PARTITION BY rollout_id ORDER BY call_index) - 1 AS pos, "
        "count(*) OVER (PARTITION BY rollout_id) AS group_rows FROM trial_calls",
        "trial_calls",
    ),
)
def log_calls_in_order(v: Views):
    calls = v["trial_calls"].select("rollout_id", "call_index")
    return anchors.positions(calls, ["rollout_id"], "call_index")


@query(
    "trial_rewards_and_tasks",
    """SELECT doc_id AS rollout_id,
    CASE WHEN doc_id % 11 = 3 THEN NULL WHEN quality IS NULL THEN NULL
         WHEN doc_id % 3 = 0 THEN CAST(quality AS DOUBLE) ELSE CAST(toxic AS DOUBLE) END AS reward,
    CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 5 = 0 THEN 'named-' || source ELSE 'trial-' || source END AS task_id
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def trial_rewards_and_tasks(v: Views):
    """Reward and task rules over result records made from documents and labels."""
    doc, quality, toxic = F.col("doc_id"), F.col("quality"), F.col("toxic")
    first = F.format_string('{"note": "7", "first": %d, "second": %d}', toxic, quality)
    named = F.format_string('{"first": %d, "reward": %d}', toxic, quality)
    rewards = F.when(quality.isNull(), '{"note": "none"}').when(doc % 3 == 0, named).otherwise(first)
    rows = v["documents"].select("doc_id", "source").join(v["labels"], "doc_id", "left").select(
        "doc_id",
        rewards.alias("rewards"),
        F.when(doc % 11 == 3, "VerifierTimeout").alias("error"),
        F.when(doc % 2 == 0, F.concat(F.lit("/tasks/"), "source")).alias("path"),
        F.when(doc % 5 == 0, F.concat(F.lit("named-"), "source")).alias("name"),
        F.concat(F.lit("job/trial-"), "source", F.lit("__x")).alias("trial"),
    )
    return rows.select(
        F.col("doc_id").alias("rollout_id"),
        logs.reward_of(logs.first_reward(F.col("rewards")), F.col("error")).alias("reward"),
        logs.task_of(F.col("path"), F.col("name"), F.col("trial")).alias("task_id"),
    )


STATUS_SQL = """CASE WHEN observation LIKE '%Previous response had parsing errors%' THEN 'rejected_parse_response'
 WHEN observation IS NULL THEN 'unconfirmed_no_observation' WHEN has_commands THEN 'execution_episode'
 ELSE 'recorded_noop_or_completion' END"""


@query(
    "trajectory_events_and_status",
    check_sql(
        f"SELECT rollout_id, step_id, row_number() OVER (PARTITION BY rollout_id ORDER BY step_id) - 1 AS occurrence, "
        f"{STATUS_SQL} AS status FROM trajectory_steps",
        "trajectory_steps",
    ),
)
def trajectory_events_and_status(v: Views):
    events = logs.flat_events(v["trajectory_steps"])
    return events.select("rollout_id", "step_id", "occurrence", "status")


@query(
    "excluded_task_trials",
    check_sql(
        """SELECT rollout_id, task_id, 'other world' AS reason, true AS raw_rollout_retained,
        false AS selection_uses_terminal_reward FROM trial_results WHERE task_id IN ('task-2', 'task-5')""",
        "trial_results",
    ),
)
def excluded_task_trials(v: Views):
    named = v.spark.createDataFrame([("task-2", "other world"), ("task-5", "other world")], "task_id string, reason string")
    return logs.split_completed(v["trial_calls"], v["trial_results"], named)[2]


@query(
    "completed_and_skipped_trials",
    check_sql(
        """SELECT rollout_id, r.rollout_id IS NOT NULL AS completed, count(*) AS calls
        FROM trial_calls LEFT JOIN (SELECT rollout_id FROM trial_results) r USING (rollout_id) GROUP BY ALL""",
        "trial_calls", "trial_results",
    ),
)
def completed_and_skipped_trials(v: Views):
    kept, skipped, _ = logs.split_completed(v["trial_calls"], v["trial_results"])
    done = kept.groupBy("rollout_id").agg(F.count(F.lit(1)).alias("calls")).withColumn("completed", F.lit(True))
    open_calls = v["trial_calls"].join(skipped.select("rollout_id"), "rollout_id", "left_semi")
    missing = open_calls.groupBy("rollout_id").agg(F.count(F.lit(1)).alias("calls")).withColumn("completed", F.lit(False))
    return done.unionByName(missing)


@query(
    "anchors_quantile",
    check_sql(
        "SELECT rollout_id, call_index, history_id, pos, n AS recorded_calls, state_id FROM anchor_rows",
        "anchor_rows",
    ),
)
def anchors_quantile(v: Views):
    return v.chosen_anchors.select(
        "rollout_id", "call_index", "history_id", "pos", "recorded_calls", "state_id"
    )


@query(
    "anchors_without_repeats",
    check_sql(
        """SELECT rollout_id, operation AS prefix_key, min(call_index) AS call_index FROM anchor_rows
        GROUP BY rollout_id, operation""",
        "anchor_rows",
    ),
)
def anchors_without_repeats(v: Views):
    chosen = v.chosen_anchors.withColumn("prefix_key", F.col("operation"))
    return anchors.dedupe(chosen).select("rollout_id", "prefix_key", "call_index")


def anchor_transitions(v: Views):
    return segments.between_anchors(v.chosen_anchors)


def aligned_records(v: Views):
    records = anchors.prefix_records(v.anchor_records)
    return segments.align(records, logs.trajectory_events(v.trajectories))


# Texts are unique within a conversation, so each visible call can only align with
# its own step; the check spells that out on flat rows.
VISIBLE = """SELECT c.rollout_id, c.call_index, c.task_id, s.step_id, s.observation, s.has_commands,
 n.turn IS NOT NULL AND n.role = 'user' AND (s.observation IS NULL OR contains(
   trim(regexp_replace(n.text, '\\s+', ' ', 'g')), trim(regexp_replace(s.observation, '\\s+', ' ', 'g')))) AS matched
 FROM conv_anchors c JOIN trajectory_steps s ON s.rollout_id = c.rollout_id AND s.step_id < c.call_index
 LEFT JOIN conv_turns n ON n.rollout_id = c.rollout_id AND n.turn = s.step_id + 1"""


@query(
    "prefix_event_alignment",
    check_sql(
        f"""SELECT CAST(rollout_id AS VARCHAR) AS rollout_id, call_index AS step, step_id AS message_step,
        CASE WHEN matched THEN {STATUS_SQL} ELSE 'unmatched_assistant_occurrence' END AS status,
        CASE WHEN matched THEN step_id END AS step_id FROM visible""",
        "conv_anchors", "trajectory_steps", "conv_turns",
        visible=VISIBLE,
    ),
)
def prefix_event_alignment(v: Views):
    rows = aligned_records(v).select("rollout_id", "step", F.explode("aligned").alias("e"))
    # In these records the message index equals the turn, hence the step id.
    return rows.select(
        "rollout_id",
        "step",
        F.col("e.prefix_message_index").alias("message_step"),
        F.col("e.status").alias("status"),
        F.col("e.step_id").alias("step_id"),
    )


@query(
    "recorded_calls",
    check_sql(
        """SELECT 'job/conv-' || c.rollout_id || '__1' AS rollout_id, c.call_index, CAST(c.call_index AS DOUBLE) + 0.5 AS observed_at_epoch,
        CASE WHEN n.turn IS NULL THEN 0 ELSE 1 END AS messages, n.role, md5(n.text) AS content, sha256(c.response) AS prefix_sha256
        FROM conv_calls c LEFT JOIN conv_turns n ON n.rollout_id = c.rollout_id AND n.turn = c.call_index - 1""",
        "conv_calls", "conv_turns",
    ),
)
def recorded_calls(v: Views):
    """Calls written as JSON lines, the last call first and with blank lines, one log per conversation, and read back."""
    root = fresh_dir(v.spark, "logs")
    before = v["conv_turns"].select("rollout_id", (F.col("turn") + 1).alias("call_index"), F.struct("role", F.col("text").alias("content")).alias("m"))
    calls = v["conv_calls"].join(before, ["rollout_id", "call_index"], "left")
    line = F.to_json(F.struct(
        F.lit("v1").alias("schema"), "call_index", (F.col("call_index") + 0.5).alias("observed_at_epoch"),
        F.array_compact(F.array("m")).alias("messages"), F.sha2("response", 256).alias("prefix_sha256"),
    ))
    artifacts.write_files(calls.select(
        F.concat(F.lit("job/conv-"), F.col("rollout_id").cast("string"), F.lit("__1/agent/policy_calls.jsonl")).alias("path"),
        (-F.col("call_index")).cast("long").alias("place"), F.concat(line, F.lit("\n\n")).cast("binary").alias("content"),
    ), root)
    read = logs.policy_calls(v.spark, root)
    first = F.get("messages", F.lit(0))
    return read.select(
        "rollout_id", "call_index", "observed_at_epoch", F.size("messages").alias("messages"), first["role"].alias("role"),
        F.md5(first["content"]).alias("content"), "prefix_sha256",
    )


# Texts of conversations with their lengths only, so that many messages read alike.
SAID, HEARD = "concat('say ', CAST(length(text) % 3 AS STRING))", "concat('got ', CAST(length(text) % 2 AS STRING))"


@query(
    "repeated_text_alignment",
    check_sql(
        f"""SELECT CAST(w.rollout_id AS VARCHAR) AS rollout_id, v.turn AS message_step, e.step_id,
        CASE WHEN e.step_id IS NULL THEN 'unmatched_assistant_occurrence' WHEN e.heard IS NULL THEN 'unconfirmed_no_observation'
             WHEN e.rollout_id % 5 <> 0 THEN 'execution_episode' ELSE 'recorded_noop_or_completion' END AS status
        FROM walk w JOIN visible v ON v.rollout_id = w.rollout_id AND v.k = w.k AND v.role = 'assistant'
        LEFT JOIN kept e ON e.rollout_id = w.rollout_id AND e.place = w.taken""",
        "conv_turns",
        visible=f"""SELECT rollout_id, turn, {SAID.replace('STRING', 'VARCHAR')} AS said,
            lead({HEARD.replace('STRING', 'VARCHAR')}) OVER t AS feedback, lead(role) OVER t AS next_role, role,
            count(*) FILTER (role = 'assistant') OVER (PARTITION BY rollout_id ORDER BY turn) AS k
            FROM conv_turns WINDOW t AS (PARTITION BY rollout_id ORDER BY turn)""",
        kept="""SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY step_id) - 1 AS place FROM (
            SELECT rollout_id, turn AS step_id, said, CASE WHEN next_role IS NOT NULL THEN feedback END AS heard
            FROM visible WHERE role = 'assistant') z WHERE (rollout_id + step_id) % 5 <> 2""",
        walk="""SELECT rollout_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS free, CAST(-2 AS BIGINT) AS taken FROM (SELECT DISTINCT rollout_id FROM conv_turns) s
            UNION ALL SELECT w.rollout_id, w.k + 1, coalesce(min(e.place) + 1, any_value(w.free)), coalesce(min(e.place), -1)
            FROM walk w JOIN visible v ON v.rollout_id = w.rollout_id AND v.k = w.k + 1 AND v.role = 'assistant'
            LEFT JOIN kept e ON e.rollout_id = w.rollout_id AND e.place >= w.free AND e.said = v.said
              AND v.next_role = 'user' AND (e.heard IS NULL OR contains(v.feedback, e.heard))
            GROUP BY w.rollout_id, w.k""",
    ),
)
def repeated_text_alignment(v: Views):
    """Whole conversations whose messages read alike, against trajectories that lack some of their steps."""
    turns = v["conv_turns"].select(
        F.col("rollout_id").cast("string").alias("rollout_id"), "conv_id", "turn", "role", F.expr(SAID).alias("said"), F.expr(HEARD).alias("heard")
    )
    content = F.when(F.col("role") == "assistant", F.col("said")).otherwise(F.col("heard"))
    lists = turns.groupBy("rollout_id", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", content.alias("content"), "said", "heard"))).alias("t"))
    following = F.transform("t", lambda m, i: F.get(F.col("t"), i + 1)["heard"])
    steps = F.transform(
        F.filter(F.arrays_zip("t", following.alias("next")), lambda z: (z["t"]["role"] == "assistant") & ((F.col("conv_id") + z["t"]["turn"]) % 5 != 2)),
        lambda z: F.struct(
            z["t"]["turn"].alias("step_id"), F.lit("agent").alias("source"), z["t"]["said"].alias("message"),
            F.when(z["next"].isNull(), F.array().cast("array<string>")).otherwise(F.array(z["next"])).alias("observations"),
            (F.col("conv_id") % 5 != 0).alias("has_commands"), F.lit(None).cast("string").alias("timestamp"),
        ),
    )
    events = logs.trajectory_events(lists.select("rollout_id", steps.alias("steps")))
    prefixes = lists.select(
        "rollout_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
        F.transform("t", lambda m: m["turn"]).alias("turns"), F.lit(None).cast("double").alias("observed_at_epoch"),
    )
    rows = segments.align(prefixes, events).select("rollout_id", "turns", F.explode("aligned").alias("e"))
    return rows.select(
        "rollout_id", F.get("turns", F.col("e.prefix_message_index").cast("int")).cast("long").alias("message_step"),
        F.col("e.step_id").cast("long").alias("step_id"), F.col("e.status").alias("status"),
    )


@query(
    "adjacent_segments",
    check_sql(
        f"""SELECT CAST(rollout_id AS VARCHAR) AS rollout_id, start_step, end_step, common_messages, action_count,
        executed, unresolved, executed > 0 AND unresolved = 0 AS confirmed FROM (
        SELECT a.rollout_id, a.start_step, a.end_step, a.start_step AS common_messages, count(*) AS action_count,
        count(*) FILTER (matched AND {STATUS_SQL} = 'execution_episode') AS executed,
        count(*) FILTER (NOT matched OR {STATUS_SQL} = 'unconfirmed_no_observation') AS unresolved
        FROM steps_between a JOIN visible x ON x.rollout_id = a.rollout_id AND x.call_index = a.end_step
          AND x.step_id >= a.start_step GROUP BY ALL) y""",
        "conv_anchors", "trajectory_steps", "conv_turns",
        visible=VISIBLE,
        steps_between="""SELECT * FROM (SELECT rollout_id, call_index AS start_step,
        lead(call_index) OVER (PARTITION BY rollout_id ORDER BY call_index) AS end_step FROM conv_anchors) z
        WHERE end_step IS NOT NULL""",
    ),
)
def adjacent_segments(v: Views):
    return segments.adjacent(aligned_records(v)).select(
        "rollout_id",
        "start_step",
        "end_step",
        "common_messages",
        F.col("action_count").cast("long").alias("action_count"),
        F.size("execution_witnesses").cast("long").alias("executed"),
        F.size("unresolved").cast("long").alias("unresolved"),
        "confirmed",
    )


@query(
    "trial_coverage",
    check_sql(
        f"""SELECT CAST(rollout_id AS VARCHAR) AS rollout_id, recorded_policy_calls, last_prefix_call_index,
        trajectory_agent_occurrences, unaligned_visible_occurrences, terminal_tail_step_ids, terminal_tail_execution_step_ids,
        CASE WHEN unaligned_visible_occurrences = 0 THEN terminal_tail_step_ids <> '' END AS terminal_response_omitted,
        CASE WHEN unaligned_visible_occurrences > 0 THEN 'uncertain_missing_trajectory_or_unmatched_visible_occurrences'
             ELSE 'ordered_tail_after_final_prefix_occurrences' END AS tail_evidence_status,
        CASE WHEN unaligned_visible_occurrences > 0 THEN 'terminal tail unknown'
             WHEN terminal_tail_step_ids <> '' THEN 'prefix_graph_excludes_terminal_response_tail'
             ELSE 'no_additional_recorded_tail; terminal coverage not independently established' END AS coverage_label
        FROM (SELECT l.rollout_id, l.n AS recorded_policy_calls, l.last AS last_prefix_call_index,
          count(*) AS trajectory_agent_occurrences,
          count(*) FILTER (x.step_id IS NOT NULL AND NOT x.matched) AS unaligned_visible_occurrences,
          coalesce(string_agg(s.step_id::VARCHAR, ',' ORDER BY s.step_id) FILTER (s.step_id > coalesce(m.last_match, -1)), '') AS terminal_tail_step_ids,
          coalesce(string_agg(s.step_id::VARCHAR, ',' ORDER BY s.step_id) FILTER (s.step_id > coalesce(m.last_match, -1) AND s.status = 'execution_episode'), '') AS terminal_tail_execution_step_ids
        FROM last_call l JOIN events_flat s ON s.rollout_id = l.rollout_id
        LEFT JOIN visible x ON x.rollout_id = l.rollout_id AND x.call_index = l.last AND x.step_id = s.step_id
        LEFT JOIN (SELECT v.rollout_id, max(v.step_id) AS last_match FROM visible v JOIN last_call c
                   ON c.rollout_id = v.rollout_id AND c.last = v.call_index WHERE v.matched GROUP BY 1) m ON m.rollout_id = l.rollout_id
        GROUP BY l.rollout_id, l.n, l.last) y""",
        "conv_anchors", "trajectory_steps", "conv_turns",
        visible=VISIBLE,
        events_flat=f"SELECT rollout_id, step_id, {STATUS_SQL} AS status FROM trajectory_steps",
        last_call="""SELECT rollout_id, max(call_index) AS last, count(DISTINCT call_index) AS n
        FROM conv_calls GROUP BY 1""",
    ),
)
def trial_coverage(v: Views):
    final = coverage.last_calls(v["conv_calls"].select("rollout_id", "call_index"))
    return coverage.tails(v.with_prefixes(final), logs.trajectory_events(v.trajectories))


def witness_rows(v: Views):
    """Transitions joined to the states of both ends."""
    chosen = v.chosen_anchors
    histories = chosen.select("history_id", "task_id", "rollout_id", F.col("call_index").alias("step"))
    moves = segments.between_anchors(chosen).select("source_id", "target_id", "operation")
    return graph.witnesses(moves, histories, chosen.select("history_id", "state_id"))


@query(
    "graph_witnesses",
    check_sql(
        """SELECT source_id, target_id, operation, source_state, target_state, task_id FROM transition_rows
        WHERE source_state IS NOT NULL AND target_state IS NOT NULL""",
        "transition_rows",
    ),
)
def graph_witnesses(v: Views):
    return graph.assigned(witness_rows(v)).select(
        "source_id", "target_id", "operation", "source_state", "target_state", "task_id"
    )


@query(
    "graph_edges",
    check_sql(
        """SELECT source_state, operation, target_state, count(*) AS witness_count,
        arg_min(source_id, source_id || '|' || target_id) AS first_source_id,
        arg_min(target_id, source_id || '|' || target_id) AS first_target_id
        FROM transition_rows WHERE source_state IS NOT NULL AND target_state IS NOT NULL
        GROUP BY source_state, operation, target_state""",
        "transition_rows",
    ),
)
def graph_edges(v: Views):
    return graph.edges(anchor_transitions(v))


@query(
    "graph_nodes",
    check_sql("SELECT state_id, count(*) AS histories FROM anchor_rows WHERE state_id IS NOT NULL GROUP BY 1", "anchor_rows"),
)
def graph_nodes(v: Views):
    return graph.nodes(v.chosen_anchors)


@query(
    "graph_unassigned_transitions",
    check_sql(
        """SELECT count(*) AS transitions, count(*) FILTER (source_state IS NULL OR target_state IS NULL) AS unassigned_transitions
        FROM transition_rows""",
        "transition_rows",
    ),
)
def graph_unassigned_transitions(v: Views):
    return graph.stats(anchor_transitions(v))


POOLED = """SELECT state_id, count(*) AS distinct_rollouts, count(*) FILTER (reward IN (0, 1)) AS graded_rollouts,
 count(DISTINCT task_id) AS distinct_tasks,
 CAST(sum(reward) FILTER (reward IN (0, 1)) AS DOUBLE) / count(*) FILTER (reward IN (0, 1)) AS pooled_success_rate
 FROM (SELECT DISTINCT a.state_id, a.rollout_id, a.task_id, r.reward FROM anchor_rows a
       LEFT JOIN trial_results r USING (rollout_id) WHERE a.state_id IS NOT NULL) x GROUP BY 1"""


def pooled_outcomes(v: Views):
    return outcomes.pool(v.chosen_anchors, v["trial_results"])


@query(
    "pooled_outcomes",
    check_sql(
        "SELECT *, pooled_success_rate * (1 - pooled_success_rate) AS pooled_binary_variance FROM pooled",
        "anchor_rows", "trial_results",
        pooled=POOLED,
    ),
)
def pooled_outcomes_query(v: Views):
    return outcomes.ranked(pooled_outcomes(v))


@query(
    "state_membership",
    check_sql(
        """SELECT s.state_id, s.members, s.tasks, coalesce(o.n, 0) AS outgoing_edges, coalesce(i.n, 0) AS incoming_edges,
        'state ' || s.state_id AS description, p.pooled_success_rate FROM
        (SELECT state_id, count(*) AS members, count(DISTINCT task_id) AS tasks FROM anchor_rows WHERE state_id IS NOT NULL GROUP BY 1) s
        LEFT JOIN (SELECT source_state AS state_id, count(*) AS n FROM e GROUP BY 1) o USING (state_id)
        LEFT JOIN (SELECT target_state AS state_id, count(*) AS n FROM e GROUP BY 1) i USING (state_id)
        LEFT JOIN pooled p USING (state_id)""",
        "transition_rows", "trial_results",
        pooled=POOLED,
        e="""SELECT DISTINCT source_state, operation, target_state FROM transition_rows
        WHERE source_state IS NOT NULL AND target_state IS NOT NULL""",
    ),
)
def state_membership(v: Views):
    chosen = v.chosen_anchors
    definitions = chosen.filter("state_id IS NOT NULL").select("state_id").distinct().withColumn(
        "description", F.concat(F.lit("state "), "state_id")
    )
    outcome = pooled_outcomes(v).select("state_id", "pooled_success_rate")
    return graph.membership(chosen, graph.edges(segments.between_anchors(chosen)), definitions, outcome)
