"""Queries: junction evidence, cross-task and shared-start paths, work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import paths, segments
from wayfold.plans.core_queries import POOLED, pooled_outcomes
from wayfold.plans.evidence_queries import bank, effective_sql
from wayfold.plans.fixtures import Views, check_sql
from wayfold.plans.registry import query

# "sp" is the label of the continuation a junction may use.
JUDGED = f"""SELECT *, CASE WHEN sp IS NULL THEN NULL ELSE {effective_sql('sp', 'proxy')} END AS s_proxy,
 CASE WHEN sp IS NULL THEN NULL ELSE {effective_sql('sp', 'grounded')} END AS s_ground FROM (
 SELECT *, {effective_sql('decision_label', 'proxy')} AS d_proxy, {effective_sql('decision_label', 'grounded')} AS d_ground,
 coalesce(full_label, CASE WHEN operation_scope = 'full_observed_segment' THEN local_label END) AS sp FROM anchor_probes) x"""
JUNCTIONS = """SELECT left_id AS left_history_id, right_id AS right_history_id,
 CASE WHEN dc OR sc THEN 'contradicted' WHEN ds AND ss THEN 'supported' ELSE 'unknown' END AS junction_status,
 CASE WHEN dc THEN 'contradicted' WHEN ds THEN 'supported' ELSE 'unknown' END AS decision_status,
 CASE WHEN dc THEN 'blocked_decision_mismatch' ELSE 'unassessed' END AS compilation_status,
 CASE WHEN NOT (dc OR sc) AND ds AND ss THEN CASE WHEN dg AND sg THEN 'grounded' ELSE 'proxy' END ELSE 'unknown_or_contradicted' END AS tier,
 exact_probe_id, exact_probes, reverse_probes FROM (
 SELECT left_id, right_id, bool_or(d_proxy = 'contradicted') AS dc, bool_or(d_proxy = 'supported') AS ds,
 coalesce(bool_or(s_proxy = 'contradicted'), false) AS sc, coalesce(bool_or(s_proxy = 'supported'), false) AS ss,
 bool_or(d_ground = 'supported') AS dg, coalesce(bool_or(s_ground = 'supported'), false) AS sg,
 min(probe_id) FILTER (exact) AS exact_probe_id, count(*) FILTER (exact) AS exact_probes, count(*) FILTER (NOT exact) AS reverse_probes
 FROM (SELECT probe_id, left_id, right_id, d_proxy, d_ground, s_proxy, s_ground, true AS exact FROM judged UNION ALL
       SELECT probe_id, right_id, left_id, d_proxy, d_ground, NULL, NULL, false FROM judged) u GROUP BY 1, 2) f"""
ALL_PATHS = """SELECT a.target_state AS state_id, a.task_id AS left_task, b.task_id AS right_task,
 least(a.task_id, b.task_id) || '|' || greatest(a.task_id, b.task_id) AS task_pair,
 a.source_id AS left_source_id, a.target_id AS left_target_id, b.source_id AS right_source_id, b.target_id AS right_target_id,
 md5(a.source_id || '|' || a.target_id) AS left_key, md5(b.source_id || '|' || b.target_id) AS right_key
 FROM transition_rows a JOIN transition_rows b ON a.target_state = b.source_state AND a.task_id <> b.task_id
 WHERE a.source_state IS NOT NULL AND b.target_state IS NOT NULL"""


def witnesses(v: Views) -> DataFrame:
    moves = segments.between_anchors(v["anchor_rows"])
    return moves.filter("source_state IS NOT NULL AND target_state IS NOT NULL")


def junction_rows(v: Views) -> DataFrame:
    return paths.junctions(bank(v["anchor_probes"], "local_label"))


@query("junction_evidence", check_sql(JUNCTIONS, "anchor_probes", judged=JUDGED))
def junction_evidence(v: Views):
    return junction_rows(v)


@query(
    "cross_task_path_totals",
    check_sql(
        """SELECT state_id, count(*) AS cross_task_paths,
        (SELECT count(*) FROM transition_rows t WHERE t.target_state = p.state_id AND t.source_state IS NOT NULL) AS incoming_witnesses,
        (SELECT count(*) FROM transition_rows t WHERE t.source_state = p.state_id AND t.target_state IS NOT NULL) AS outgoing_witnesses
        FROM all_paths p GROUP BY 1""",
        "transition_rows",
        all_paths=ALL_PATHS,
    ),
)
def cross_task_path_totals(v: Views):
    return paths.totals(witnesses(v))


RANKED = """SELECT p.*, coalesce(j.junction_status, 'unknown') AS junction_status, coalesce(j.compilation_status, 'unassessed') AS compilation_status,
 CASE WHEN j.junction_status = 'supported' THEN 0 ELSE 1 END AS unsupported,
 coalesce(o.pooled_success_rate * (1 - o.pooled_success_rate), 0) AS variance, o.distinct_rollouts FROM all_paths p
 LEFT JOIN junctions j ON j.left_history_id = p.left_target_id AND j.right_history_id = p.right_source_id
 LEFT JOIN pooled o USING (state_id)"""


@query(
    "judged_paths",
    check_sql(
        """SELECT left_source_id, left_target_id, right_source_id, right_target_id, state_id, junction_status, compilation_status
        FROM (SELECT p.*, j.junction_status, j.compilation_status FROM all_paths p JOIN junctions j
        ON j.left_history_id = p.left_target_id AND j.right_history_id = p.right_source_id) x""",
        "anchor_probes", "transition_rows",
        judged=JUDGED, junctions=JUNCTIONS, all_paths=ALL_PATHS,
    ),
)
def judged_paths(v: Views):
    found = junction_rows(v)
    rows = paths.judged(witnesses(v), found)
    keyed = found.withColumnsRenamed({"left_history_id": "left_target_id", "right_history_id": "right_source_id"})
    return rows.join(keyed, ["left_target_id", "right_source_id"]).select(
        "left_source_id", "left_target_id", "right_source_id", "right_target_id", "state_id", "junction_status", "compilation_status"
    )


@query(
    "blocked_paths",
    check_sql(
        """SELECT state_id AS target_state, left_source_id, left_target_id, right_source_id, right_target_id FROM ranked
        WHERE compilation_status = 'blocked_decision_mismatch'""",
        "anchor_probes", "transition_rows", "trial_results",
        judged=JUDGED, junctions=JUNCTIONS, all_paths=ALL_PATHS, pooled=POOLED, ranked=RANKED,
    ),
)
def blocked_paths(v: Views):
    found, outcome = junction_rows(v), pooled_outcomes(v)
    rows = paths._with_evidence(paths.judged(witnesses(v), found), found, outcome)
    return rows.filter("compilation_status = 'blocked_decision_mismatch'").select(
        "target_state", "left_source_id", "left_target_id", "right_source_id", "right_target_id"
    )


@query(
    "best_path_per_state_and_task_pair",
    check_sql(
        """SELECT state_id AS target_state, task_pair, left_source_id, left_target_id, right_source_id, right_target_id, junction_status FROM (
        SELECT *, row_number() OVER (PARTITION BY state_id, task_pair ORDER BY unsupported, left_key, right_key) AS k
        FROM ranked WHERE compilation_status <> 'blocked_decision_mismatch') x WHERE k = 1""",
        "anchor_probes", "transition_rows", "trial_results",
        judged=JUDGED, junctions=JUNCTIONS, all_paths=ALL_PATHS, pooled=POOLED, ranked=RANKED,
    ),
)
def best_path_per_state_and_task_pair(v: Views):
    picked = paths.best_per_task_pair(witnesses(v), junction_rows(v), pooled_outcomes(v))
    return picked.select(
        "target_state", "task_pair", "left_source_id", "left_target_id", "right_source_id", "right_target_id", "junction_status"
    )


def diverse_sql(condition: str) -> dict[str, str]:
    """CTEs that choose from all listed paths one by one, in the five passes."""
    order = "unsupported, -variance, -coalesce(distinct_rollouts, 0), left_key, right_key"
    best = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rk) AS k FROM placed WHERE {open}) x WHERE k = 1"
    taken = "(SELECT {key} FROM {table})"

    def later(number: int, key: str, before: str) -> str:
        columns = f"({key})" if "," in key else key
        picked = best.format(key=key, open=f"{columns} NOT IN {taken.format(key=key, table=before)}")
        return f"SELECT * FROM {before} UNION ALL SELECT rk, {number}, state_id, task_pair FROM ({picked}) y"

    return dict(
        placed=f"SELECT *, row_number() OVER (ORDER BY {order}) AS rk FROM ranked WHERE {condition}",
        heads=f"""SELECT rk, state_id, task_pair, row_number() OVER (ORDER BY rk) AS i
        FROM ({best.format(key='state_id, task_pair', open='true')}) z""",
        walk_heads="""SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ts, CAST([] AS VARCHAR[]) AS ps, CAST([] AS BIGINT[]) AS ids
        UNION ALL SELECT h.i, CASE WHEN free THEN list_append(ts, h.state_id) ELSE ts END, CASE WHEN free THEN list_append(ps, h.task_pair) ELSE ps END,
        CASE WHEN free THEN list_append(ids, h.rk) ELSE ids END FROM (
          SELECT w.*, h.i AS hi, NOT list_contains(w.ts, h.state_id) AND NOT list_contains(w.ps, h.task_pair) AS free
          FROM walk_heads w JOIN heads h ON h.i = w.i + 1) s JOIN heads h ON h.i = s.hi""",
        pass0="""SELECT rk, 0 AS pass, state_id, task_pair FROM heads WHERE rk IN (
        SELECT unnest(ids) FROM walk_heads WHERE i = (SELECT max(i) FROM walk_heads))""",
        pass1=later(1, "state_id", "pass0"),
        pass2=later(2, "task_pair", "pass1"),
        pass3=later(3, "state_id, task_pair", "pass2"),
        chosen="""SELECT * FROM pass3 UNION ALL SELECT rk, 4, state_id, task_pair FROM placed WHERE rk NOT IN (SELECT rk FROM pass3)""",
    )


PATH_CTES = dict(judged=JUDGED, junctions=JUNCTIONS, all_paths=ALL_PATHS, pooled=POOLED, ranked=RANKED)
PATH_VIEWS = ("anchor_probes", "transition_rows", "trial_results")
OPEN = "compilation_status <> 'blocked_decision_mismatch'"
PATH_ID = """'cross-task-' || substr(sha256('["' || left_source_id || '","' || left_target_id || '","' || right_source_id || '","' || right_target_id || '"]'), 1, 12)"""


@query(
    "selected_paths",
    check_sql(
        f"""SELECT pass, {PATH_ID} AS path_id, p.state_id AS target_state, p.task_pair, left_source_id, left_target_id, right_source_id, right_target_id,
        p.junction_status, coalesce(j.tier, 'unknown_or_contradicted') AS tier,
        CASE WHEN variance > 0 THEN 'positive pooled outcome variance' ELSE 'high-support fallback; no positive variance for this node' END AS selection_reason
        FROM chosen c JOIN placed p USING (rk) LEFT JOIN junctions j ON j.left_history_id = left_target_id AND j.right_history_id = right_source_id
        ORDER BY pass, rk LIMIT 12""",
        *PATH_VIEWS,
        **PATH_CTES, **diverse_sql(OPEN),
    ),
)
def selected_paths(v: Views):
    """Diverse choice of cross-task paths."""
    chosen, _ = paths.cross_task(witnesses(v), junction_rows(v), pooled_outcomes(v), limit=12)
    return chosen.select(
        "pass", "path_id", "target_state", "task_pair", "left_source_id", "left_target_id",
        "right_source_id", "right_target_id", "junction_status", "tier", "selection_reason",
    )


@query(
    "unjudged_junction_shortlist",
    check_sql(
        """SELECT left_target_id, right_source_id, pass FROM (SELECT left_target_id, right_source_id, pass, rk,
        row_number() OVER (PARTITION BY left_target_id, right_source_id ORDER BY pass, rk) AS k FROM chosen JOIN placed USING (rk)) x
        WHERE k = 1 ORDER BY pass, rk LIMIT 3""",
        *PATH_VIEWS,
        **PATH_CTES, **diverse_sql(f"{OPEN} AND junction_status = 'unknown'"),
    ),
)
def unjudged_junction_shortlist(v: Views):
    return paths.unjudged_shortlist(witnesses(v), junction_rows(v), pooled_outcomes(v))


@query(
    "selected_paths_with_context",
    check_sql(
        f"""SELECT {PATH_ID} AS path_id, p.state_id AS target_state, 'state ' || p.state_id AS description,
        a.operation || ' ' || a.value AS junction_prefix_a, b.operation || ' ' || b.value AS junction_prefix_b, l.operation AS left_effect, r.operation AS right_effect,
        o.pooled_success_rate * (1 - o.pooled_success_rate) AS pooled_binary_variance, p.distinct_rollouts
        FROM (SELECT * FROM chosen ORDER BY pass, rk LIMIT 8) c JOIN placed p USING (rk) JOIN anchor_rows a ON a.history_id = left_target_id
        JOIN anchor_rows b ON b.history_id = right_source_id JOIN transition_rows l ON l.source_id = left_source_id
        JOIN transition_rows r ON r.source_id = right_source_id LEFT JOIN pooled o ON o.state_id = p.state_id""",
        "anchor_rows", *PATH_VIEWS,
        **PATH_CTES, **diverse_sql(OPEN),
    ),
)
def selected_paths_with_context(v: Views):
    moves = witnesses(v)
    chosen, _ = paths.cross_task(moves, junction_rows(v), pooled_outcomes(v), limit=8)
    definitions = moves.select(F.col("target_state").alias("state_id")).distinct().withColumn(
        "description", F.concat(F.lit("state "), "state_id")
    )
    prefixes = v["anchor_rows"].select("history_id", F.concat_ws(" ", "operation", F.col("value").cast("string")).alias("prefix"))
    effects = moves.select("source_id", "target_id", F.col("operation").alias("effect"))
    return paths.enrich(chosen, definitions, prefixes, effects, 8).select(
        "path_id", "target_state", "description", "junction_prefix_a", "junction_prefix_b", "left_effect", "right_effect",
        "pooled_binary_variance", "distinct_rollouts",
    )


SHARED = """SELECT p.probe_id, p.left_id, p.right_id, p.left_task, p.right_task, l.source_state AS target_state,
 CASE WHEN NOT (p.decision_label = 'supported' AND p.local_label = 'supported') THEN 'decision and local transfer support both required'
 WHEN p.place <> 0 THEN 'both histories must be initial'
 WHEN p.left_task = p.right_task THEN 'distinct source tasks required'
 WHEN l.source_id IS NULL OR r.source_id IS NULL THEN 'one observed first segment per history required'
 WHEN l.source_state <> r.source_state THEN 'both histories must share a state'
 WHEN l.start_step % 13 = 0 OR r.start_step % 13 = 0 THEN 'observed segment missing'
 WHEN l.start_step % 17 = 0 OR r.start_step % 17 = 0 THEN 'graph and segment identities differ' ELSE 'Eligible' END AS eligibility
 FROM anchor_probes p LEFT JOIN full_moves l ON l.source_id = p.left_id LEFT JOIN full_moves r ON r.source_id = p.right_id"""
FULL_MOVES = "SELECT * FROM transition_rows WHERE source_state IS NOT NULL AND target_state IS NOT NULL"


def shared_start_rows(v: Views) -> DataFrame:
    moves = witnesses(v).withColumn("witness_ref", F.concat(F.lit("seg-"), "source_id"))
    recorded = moves.filter("start_step % 13 <> 0").select(
        "witness_ref",
        "source_id",
        F.when(F.col("start_step") % 17 == 0, "elsewhere").otherwise(F.col("target_id")).alias("target_id"),
    )
    first = F.min("call_index").alias("call_index")
    starts = v["anchor_rows"].groupBy("rollout_id").agg(first).withColumn("step", F.lit(0))
    histories = v["anchor_rows"].select("history_id", "task_id", "rollout_id", "call_index").join(
        starts, ["rollout_id", "call_index"], "left"
    ).fillna(1, ["step"])
    judgments = v["anchor_probes"].select("probe_id", "left_id", "right_id", "decision_label", "local_label", "full_label")
    return paths.shared_start(judgments, histories, moves, recorded)


@query(
    "shared_start_eligibility",
    check_sql(SHARED, "anchor_probes", "transition_rows", full_moves=FULL_MOVES),
)
def shared_start_eligibility(v: Views):
    return shared_start_rows(v)


@query(
    "shared_start_selection",
    check_sql(
        """SELECT probe_id, left_id, right_id, target_state FROM (SELECT *, row_number() OVER (
        PARTITION BY least(left_task, right_task), greatest(left_task, right_task)
        ORDER BY NOT starts_with(probe_id, 'train-'), probe_id) AS k FROM shared WHERE eligibility = 'Eligible') x WHERE k = 1
        ORDER BY NOT starts_with(probe_id, 'train-'), probe_id LIMIT 3""",
        "anchor_probes", "transition_rows",
        full_moves=FULL_MOVES, shared=SHARED,
    ),
)
def shared_start_selection(v: Views):
    return paths.shared_start_selection(shared_start_rows(v), 3).select("probe_id", "left_id", "right_id", "target_state")


# Paths of the work queue: judged pairs stand for paths, in probe order.
QUEUE_PATHS = """SELECT 'path-' || probe_id AS path_id, 'S' || place AS target_state,
 least(left_task, right_task) || '|' || greatest(left_task, right_task) AS task_pair, probe_id, left_id, right_id,
 decision_label, local_label, full_label FROM anchor_probes"""


def queue_paths(v: Views) -> DataFrame:
    rows = v["anchor_probes"]
    return rows.select(
        F.concat(F.lit("path-"), "probe_id").alias("path_id"),
        F.concat(F.lit("S"), F.col("place").cast("string")).alias("target_state"),
        F.concat_ws("|", F.least("left_task", "right_task"), F.greatest("left_task", "right_task")).alias("task_pair"),
        F.col("probe_id").alias("exact_probe_id"),
        F.col("left_id").alias("left_target_id"),
        F.col("right_id").alias("right_source_id"),
    )


@query(
    "exact_judgments",
    check_sql(
        "SELECT path_id, probe_id, left_id, right_id, decision_label, local_label, full_label FROM q WHERE full_label IS NOT NULL",
        "anchor_probes",
        q=QUEUE_PATHS,
    ),
)
def exact_judgments(v: Views):
    saved = v["anchor_probes"].select("probe_id", "left_id", "right_id", "decision_label", "local_label", "full_label")
    return paths.exact_judgments(queue_paths(v), saved)


@query(
    "work_queue",
    check_sql(
        """SELECT path_id, target_state, task_pair, CASE WHEN full_label IS NULL THEN 'needs_original_junction_judgment'
        WHEN decision_label = 'contradicted' THEN 'unsupported_target' ELSE 'ready' END AS queue_status FROM (
        SELECT *, row_number() OVER (PARTITION BY target_state, task_pair ORDER BY path_id) AS k FROM q
        WHERE NOT (local_label = 'contradicted')) x WHERE k = 1 ORDER BY path_id LIMIT 12""",
        "anchor_probes",
        q=QUEUE_PATHS,
    ),
)
def work_queue(v: Views):
    saved = v["anchor_probes"].select("probe_id", "left_id", "right_id", "decision_label", "local_label", "full_label")
    ledger = saved.select(
        F.concat(F.lit("path-"), "probe_id").alias("path_id"),
        F.when(F.col("local_label") == "contradicted", "construction_failed").otherwise("error").alias("status"),
    )
    queue = paths.work_queue(queue_paths(v), ledger, saved, ["path_id"], 12)
    return queue.select("path_id", "target_state", "task_pair", "queue_status")


@query(
    "segment_receipts",
    check_sql(
        """SELECT source_id AS request_id, 'seg-' || source_id AS witness_ref, CASE WHEN start_step % 13 = 0 THEN 'segment missing'
        WHEN start_step % 17 = 0 THEN 'histories differ' WHEN operation = 'error' THEN 'no confirmed episode' ELSE 'ok' END AS receipt
        FROM transition_rows""",
        "transition_rows",
    ),
)
def segment_receipts(v: Views):
    moves = segments.between_anchors(v["anchor_rows"]).withColumn("witness_ref", F.concat(F.lit("seg-"), "source_id"))
    recorded = moves.filter("start_step % 13 <> 0").select(
        "witness_ref",
        "source_id",
        F.when(F.col("start_step") % 17 == 0, "elsewhere").otherwise(F.col("target_id")).alias("target_id"),
        F.when(F.col("operation") == "error", 0).otherwise(1).alias("executed"),
    )
    requests = moves.select(F.col("source_id").alias("request_id"), "witness_ref", "source_id", "target_id")
    return paths.segment_receipts(requests, recorded)
