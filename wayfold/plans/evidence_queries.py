"""Queries: evidence, probe scoring, integrity, pairs and splits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import evidence
from wayfold.operators import pairs, probes, rules, splits
from wayfold.plans.fixtures import Views, check_sql
from wayfold.plans.registry import query

TIER = """CASE WHEN NOT independent OR {label} = 'unknown' THEN 'unknown' WHEN method = 'synthetic' THEN 'synthetic'
 WHEN method = 'llm' THEN 'proxy' WHEN audited THEN 'grounded' ELSE 'unknown' END"""
EFFECTIVE = "CASE WHEN ({tier}) IN ('grounded', '{mode}') THEN {label} ELSE 'unknown' END"


def tier_sql(label: str) -> str:
    return TIER.format(label=label)


def effective_sql(label: str, mode: str) -> str:
    return EFFECTIVE.format(tier=tier_sql(label), label=label, mode=mode)


def judged(label: Column | str) -> Column:
    return F.struct(
        (F.col(label) if isinstance(label, str) else label).alias("label"),
        F.col("method"),
        F.lit("judge").alias("source_ref"),
        F.col("independent"),
        F.col("audited"),
        F.lit("").alias("rationale"),
    )


def bank(rows: DataFrame, splice: str = "splice_label") -> DataFrame:
    full = F.when(F.col("full_label").isNotNull(), judged("full_label"))
    scope = F.col("operation_scope") if "operation_scope" in rows.columns else F.lit("full_observed_segment")
    return rows.select(
        "probe_id", "left_id", "right_id",
        judged("decision_label").alias("decision"),
        judged(splice).alias("splice"),
        full.alias("full_segment"),
        scope.alias("operation_scope"),
    )


@query(
    "evidence_tiers",
    check_sql(
        f"""SELECT probe_id, {tier_sql('decision_label')} AS decision_tier,
        {effective_sql('decision_label', 'grounded')} AS grounded_label, {effective_sql('decision_label', 'proxy')} AS proxy_label,
        {effective_sql('decision_label', 'synthetic')} AS synthetic_label FROM probes""",
        "probes",
    ),
)
def evidence_tiers(v: Views):
    rows = bank(v["probes"])
    return rows.select(
        "probe_id",
        probes.tier_of("decision").alias("decision_tier"),
        *[probes.effective_of("decision", m).alias(f"{m}_label") for m in evidence.MODES],
    )


@query(
    "replay_conflicts",
    check_sql(
        """SELECT probe_id, 'replay_0_' || scope AS conflict_id, scope, label FROM (
        SELECT probe_id, 'decision' AS scope, decision_label AS label FROM probes UNION ALL
        SELECT probe_id, 'local_transfer', splice_label FROM probes UNION ALL
        SELECT probe_id, 'full_segment_transfer', full_label FROM probes) x WHERE label <> 'supported'""",
        "probes",
    ),
)
def replay_conflict_rows(v: Views):
    rows = v["probes"].select(
        "probe_id",
        F.lit(0).alias("record_index"),
        F.col("decision_label").alias("decision"),
        F.col("splice_label").alias("local_transfer"),
        F.col("full_label").alias("full_segment_transfer"),
    )
    return replay_conflicts(rows).select("probe_id", "conflict_id", "scope", "label")


def replay_conflicts(judgments: DataFrame) -> DataFrame:
    """One row per judgment and scope that is not supported, with a stable id."""
    scopes = ["decision", "local_transfer", "full_segment_transfer"]
    long = judgments.unpivot(["probe_id", "record_index"], scopes, "scope", "label")
    checked = long.withColumn(
        "label",
        F.when(F.col("label").isin(*evidence.LABELS), F.col("label")).otherwise(
            F.raise_error(F.concat(F.lit("judgment lacks a valid label for "), "scope"))
        ),
    )
    return checked.filter(F.col("label") != "supported").withColumn(
        "conflict_id",
        F.concat_ws("_", F.lit("replay"), F.col("record_index").cast("string"), "scope"),
    )


LABELLED = f"""SELECT p.*, a.candidate_id, a.candidate_index, coalesce(a.state_id = b.state_id, false) AS offered,
 {effective_sql('decision_label', 'proxy')} AS d, {effective_sql('splice_label', 'proxy')} AS s
 FROM probes_cross p JOIN candidate_assignments a ON a.history_id = p.left_id
 JOIN candidate_assignments b ON b.history_id = p.right_id AND b.candidate_id = a.candidate_id"""
STATUS = """CASE WHEN NOT offered THEN 'not_connected' WHEN d = 'contradicted' OR s = 'contradicted' THEN 'invalid'
 WHEN d = 'supported' AND s = 'supported' THEN 'valid' ELSE 'unknown' END"""
SCORED = f"SELECT *, CASE status WHEN 'valid' THEN 1.0E0 WHEN 'invalid' THEN -4.0E0 ELSE 0.0E0 END AS score FROM (SELECT *, {STATUS} AS status FROM labelled) x"


@query(
    "probe_scores",
    check_sql(
        "SELECT probe_id, candidate_id, offered, status, score, d AS decision_label, s AS splice_label FROM scored",
        "probes_cross", "candidate_assignments",
        labelled=LABELLED, scored=SCORED,
    ),
)
def probe_scores(v: Views):
    return probes.score(bank(v["probes_cross"]), v["candidate_assignments"]).select(
        "probe_id", "candidate_id", "offered", "status", "score", "decision_label", "splice_label"
    )


def _mode_summary(mode: str) -> str:
    d, s = effective_sql("decision_label", mode), effective_sql("splice_label", mode)
    status = STATUS.replace("d =", f"({d}) =").replace("s =", f"({s}) =")
    return f"""SELECT candidate_id, '{mode}' AS mode, count(*) FILTER (st = 'valid') AS valid, count(*) FILTER (st = 'invalid') AS invalid,
    count(*) FILTER (st = 'unknown') AS "unknown", count(*) FILTER (st = 'not_connected') AS not_connected, count(*) AS denominator,
    (count(*) FILTER (st = 'valid') - 4 * count(*) FILTER (st = 'invalid'))::DOUBLE / count(*) AS mean_score
    FROM (SELECT candidate_id, {status} AS st FROM labelled) x GROUP BY 1"""


@query(
    "probe_summary_by_mode",
    check_sql(
        " UNION ALL ".join(_mode_summary(m) for m in evidence.MODES),
        "probes_cross", "candidate_assignments",
        labelled=LABELLED,
    ),
)
def probe_summary_by_mode(v: Views):
    return probes.summarize_modes(bank(v["probes_cross"]), v["candidate_assignments"])


@query(
    "joint_evidence_counts",
    check_sql(
        f"""SELECT split, count(*) FILTER (j = 'supported') AS supported, count(*) FILTER (j = 'contradicted') AS contradicted,
        count(*) FILTER (j = 'unknown') AS "unknown", count(*) AS total FROM (
        SELECT split_part(probe_id, '-', 1) AS split, CASE WHEN d = 'contradicted' OR s = 'contradicted' THEN 'contradicted'
        WHEN d = 'supported' AND s = 'supported' THEN 'supported' ELSE 'unknown' END AS j FROM (
        SELECT probe_id, {effective_sql('decision_label', 'proxy')} AS d, {effective_sql('splice_label', 'proxy')} AS s
        FROM probes_cross) x) y GROUP BY 1""",
        "probes_cross",
    ),
)
def joint_evidence_counts(v: Views):
    rows = bank(v["probes_cross"]).withColumn("split", F.substring_index("probe_id", "-", 1))
    return probes.joint_counts(rows, "split")


def candidate_table(v: Views) -> DataFrame:
    names = v["candidate_assignments"].select("candidate_id", "candidate_index").distinct()
    broken = names.agg(F.lit("c99").alias("candidate_id"), F.lit(99).alias("candidate_index"))
    return names.withColumn("valid", F.lit(True)).unionByName(broken.withColumn("valid", F.lit(False)))


BOARD = """SELECT candidate_id, candidate_index, true AS valid, count(*) AS scored_probes,
 count(*) FILTER (status = 'valid') AS valid_probes, count(*) FILTER (status = 'invalid') AS invalid_probes,
 count(*) FILTER (status = 'unknown') AS unknown_probes, count(*) FILTER (status = 'not_connected') AS not_connected_probes,
 (SELECT count(*) FROM probes_cross) AS denominator, sum(score) / (SELECT count(*) FROM probes_cross) AS mean_score,
 sum(score) FILTER (starts_with(probe_id, 'validation-')) / (SELECT count(*) FROM probes_cross WHERE starts_with(probe_id, 'validation-')) AS subset_score
 FROM scored GROUP BY 1, 2 UNION ALL
 SELECT 'c99', 99, false, 0, 0, 0, 0, 0, count(*), -4.0E0, -4.0E0 FROM probes_cross"""


def board(v: Views) -> DataFrame:
    return probes.leaderboard(
        candidate_table(v),
        v["candidate_assignments"],
        bank(v["probes_cross"]),
        subset=F.col("probe_id").startswith("validation-"),
    )


@query(
    "candidate_leaderboard",
    check_sql(
        BOARD, "probes_cross", "candidate_assignments", labelled=LABELLED, scored=SCORED
    ),
)
def candidate_leaderboard(v: Views):
    return board(v)


@query(
    "best_candidate",
    check_sql(
        """SELECT arg_min(candidate_id, -mean_score * 1000000 + candidate_index / 1000.0) AS best_candidate,
        max(mean_score) AS best_score, count(*) AS candidates FROM board""",
        "probes_cross", "candidate_assignments",
        labelled=LABELLED, scored=SCORED, board=BOARD,
    ),
)
def best_candidate(v: Views):
    return probes.best(board(v))


def _word(text: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256({text}), 1, 15) AS BIGINT) AS HUGEINT)"


@query(
    "bank_fingerprint",
    check_sql(
        f"""SELECT probes, sha256(probes || '|' || a || '|' || b) AS bank_sha256 FROM (
        SELECT count(*) AS probes, sum({_word("'a' || t")}) AS a, sum({_word("'b' || t")}) AS b FROM (
        SELECT concat_ws(chr(31), probe_id, CAST(audited AS VARCHAR), decision_label, full_label, CAST(independent AS VARCHAR),
          CAST(left_id AS VARCHAR), left_task, method, CAST(right_id AS VARCHAR), right_task, splice_label) AS t
        FROM probes_cross) x) y""",
        "probes_cross",
    ),
)
def bank_fingerprint(v: Views):
    return probes.bank_fingerprint(v["probes_cross"])


@query(
    "probe_integrity",
    check_sql(
        """SELECT probe_id AS row_id, 'same_task' AS rule, left_task AS detail FROM probes WHERE left_task = right_task UNION ALL
        SELECT probe_id, 'absent_right', CAST(right_id AS VARCHAR) FROM probes WHERE right_id % 17 = 0 UNION ALL
        SELECT probe_id, 'absent_left', CAST(left_id AS VARCHAR) FROM probes WHERE left_id % 17 = 0
        """.replace("left_task = right_task", "left_task = right_task AND left_id % 17 <> 0 AND right_id % 17 <> 0"),
        "probes",
    ),
)
def probe_integrity(v: Views):
    return rules.probe_integrity(v["probes"], v["histories"].filter("history_id % 17 <> 0"))


@query(
    "transition_integrity",
    check_sql(
        """SELECT source_id AS row_id, 'step_not_increasing' AS rule, target_id AS detail FROM moved WHERE NOT (source_step < target_step) UNION ALL
        SELECT source_id, 'cross_rollout', target_id FROM moved WHERE s_roll <> t_roll UNION ALL
        SELECT source_id, 'empty_operation', target_id FROM moved WHERE operation = '' UNION ALL
        SELECT source_id, 'empty_witness', target_id FROM moved WHERE operation = 'error' """,
        "anchor_rows",
        moved="""SELECT a.history_id AS source_id, b.history_id AS target_id, a.call_index AS source_step, b.call_index AS target_step,
        a.rollout_id AS s_roll, b.rollout_id AS t_roll, CASE WHEN a.value < 8 THEN '' ELSE a.operation END AS operation
        FROM anchor_rows a JOIN anchor_rows b ON b.pos = a.pos AND b.rollout_id = a.rollout_id + 1""",
    ),
)
def transition_integrity(v: Views):
    chosen = v["anchor_rows"]
    histories = chosen.select("history_id", "task_id", "rollout_id", F.col("call_index").alias("step"))
    here = chosen.select("pos", "rollout_id", "value", "operation", F.col("history_id").alias("source_id"))
    there = chosen.select("pos", (F.col("rollout_id") - 1).alias("rollout_id"), F.col("history_id").alias("target_id"))
    moved = here.join(there, ["pos", "rollout_id"]).select(
        "source_id",
        "target_id",
        F.when(F.col("value") < 8, "").otherwise(F.col("operation")).alias("operation"),
        F.when((F.col("operation") != "error") | (F.col("value") < 8), "w").alias("witness_ref"),
    )
    return rules.transition_integrity(moved, histories)


@query(
    "assignment_integrity",
    """SELECT CAST(doc_id AS VARCHAR) AS row_id, 'unassigned_history' AS rule, '' AS detail FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0) UNION ALL
    SELECT CAST(doc_id + 100000000 AS VARCHAR), 'assignment_without_history', '' FROM labels WHERE doc_id % 10 = 1 UNION ALL
    SELECT CAST(doc_id AS VARCHAR), 'duplicate_assignment', '2' FROM labels WHERE doc_id % 3 <> 0 AND doc_id % 10 = 2""",
)
def assignment_integrity(v: Views):
    labelled = v["labels"].select(F.col("doc_id").alias("history_id"))
    kept = labelled.filter("history_id % 3 <> 0")
    stray = labelled.filter("history_id % 10 = 1").select((F.col("history_id") + 100000000).alias("history_id"))
    rows = kept.unionByName(kept.filter("history_id % 10 = 2")).unionByName(stray)
    return rules.assignment_integrity(rows, v["histories"])


@query(
    "split_by_task",
    check_sql(
        """SELECT task_id, CASE WHEN row_number() OVER (ORDER BY md5('7|' || task_id)) <=
        greatest(2, least(n - 2, CAST(round_even(n * 0.25, 0) AS BIGINT))) THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT DISTINCT task_id, (SELECT count(DISTINCT task_id) FROM histories) AS n FROM histories) x""",
        "histories",
    ),
)
def split_by_task(v: Views):
    return splits.by_group(v["histories"], seed=7)


# Brute force over every pair of documents that shares a word.
WORDS = """SELECT DISTINCT history_id, task_id, has_segment, unnest(regexp_extract_all(lower(prefix), '[a-z]{4,}')) AS word FROM histories"""
CLASSED = """SELECT h.history_id, h.task_id, h.has_segment, count(w.word) AS total,
 coalesce(string_agg(w.word, ' ' ORDER BY w.df, w.word) FILTER (w.df > 1), '') AS shared FROM histories h
 LEFT JOIN (SELECT history_id, word, count(*) OVER (PARTITION BY word) AS df FROM words) w USING (history_id) GROUP BY ALL"""


SHARING = """SELECT a.history_id AS x, b.history_id AS y, count(*) AS o FROM words a JOIN words b
 ON a.word = b.word AND a.history_id < b.history_id GROUP BY ALL"""


@query(
    "similar_history_classes",
    check_sql(
        """SELECT least(ca, cb) AS left_class, greatest(ca, cb) AS right_class, o AS shared_words, ta + tb - o AS union_words,
        o::DOUBLE / (ta + tb - o) AS similarity, count(*) AS pairs FROM (
        SELECT a.history_id AS x, b.history_id AS y, md5(a.total || ' ' || a.shared) AS ca, md5(b.total || ' ' || b.shared) AS cb,
        a.total AS ta, b.total AS tb, s.o FROM sharing s JOIN classed a ON a.history_id = s.x JOIN classed b ON b.history_id = s.y
        WHERE a.task_id <> b.task_id AND (a.has_segment OR b.has_segment)) z
        WHERE o::DOUBLE / (ta + tb - o) >= 0.6 GROUP BY ALL""",
        "histories",
        words=WORDS,
        classed=CLASSED,
        sharing=SHARING,
    ),
)
def similar_history_classes(v: Views):
    members, found = pairs.classes(v["histories"])
    return pairs.pair_counts(members, pairs.similar_classes(found, 0.6)).filter("pairs > 0")


# Every usable pair with its number: x has a segment, y follows in a later task or has none.
USABLE = """SELECT row_number() OVER (ORDER BY a.task_id, a.history_id, NOT b.has_segment, b.task_id, b.history_id) - 1 AS u,
    CASE WHEN b.has_segment THEN least(a.history_id, b.history_id) ELSE b.history_id END AS left_id,
    CASE WHEN b.has_segment THEN greatest(a.history_id, b.history_id) ELSE a.history_id END AS right_id
    FROM histories a JOIN histories b ON a.has_segment AND a.task_id <> b.task_id AND (NOT b.has_segment OR b.task_id > a.task_id)"""


def draws_sql(seed: int, count: int) -> str:
    """More draws than are needed, each pair at its first one."""
    return f"""SELECT min(k) AS k, u FROM (SELECT k, CAST('0x' || substr(md5('{seed}|' || k), 1, 15) AS BIGINT)
        % (SELECT count(*) FROM usable) AS u FROM range(0, {20 * count + 1000}) r(k)) d GROUP BY u"""


def selection_sql(count: int, seed: int, tag: str = "") -> dict[str, str]:
    """CTEs that rank every pair and take them one by one, then add the seeded rest."""
    wanted = -(-count * 3 // 4)
    uses = "len(list_filter(w.used, lambda n: n = {})) < 3"
    oriented = "CASE WHEN a.has_segment AND NOT b.has_segment THEN b.history_id ELSE a.history_id END AS left_id, CASE WHEN a.has_segment AND NOT b.has_segment THEN a.history_id ELSE b.history_id END AS right_id"
    usable = "a.task_id <> b.task_id AND (a.has_segment OR b.has_segment)"
    ctes = dict(
        words=WORDS,
        sizes="SELECT history_id, task_id, has_segment, count(word) AS total FROM histories LEFT JOIN (SELECT history_id, word FROM words) w USING (history_id) GROUP BY ALL",
        sharing=SHARING,
        scored=f"""SELECT {oriented}, s.o::DOUBLE / greatest(1, a.total + b.total - s.o) AS similarity FROM sharing s
        JOIN sizes a ON a.history_id = s.x JOIN sizes b ON b.history_id = s.y WHERE {usable}""",
        placed="SELECT *, row_number() OVER (ORDER BY similarity DESC, left_id, right_id) AS i FROM scored",
        walk_pairs=f"""SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS ids UNION ALL
        SELECT p.i, CASE WHEN free THEN list_concat(used, [p.left_id, p.right_id]) ELSE used END, CASE WHEN free THEN list_append(ids, p.i) ELSE ids END
        FROM (SELECT w.*, p.*, {uses.format('p.left_id')} AND {uses.format('p.right_id')} AS free FROM walk_pairs w JOIN placed p ON p.i = w.i + 1
              WHERE len(w.ids) < {wanted}) q(wi, used, ids, left_id, right_id, similarity, pi, free) JOIN placed p ON p.i = q.pi""",
        taken="SELECT left_id, right_id, similarity FROM placed WHERE i IN (SELECT unnest(ids) FROM walk_pairs WHERE i = (SELECT max(i) FROM walk_pairs))",
        usable=USABLE,
        draws=draws_sql(seed, count),
        rest=f"""SELECT left_id, right_id FROM draws JOIN usable USING (u)
        WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.left_id = usable.left_id AND t.right_id = usable.right_id)
        ORDER BY k LIMIT {count - wanted}""",
        selection="""SELECT left_id, right_id, similarity, 'similar' AS picked_by FROM taken UNION ALL
        SELECT left_id, right_id, coalesce(s.similarity, 0), 'seeded' FROM rest LEFT JOIN scored s USING (left_id, right_id)""",
    )
    own = r"\b(walk_pairs|taken|draws|rest|selection)\b"
    return {re.sub(own, rf"\1{tag}", name): re.sub(own, rf"\1{tag}", body) for name, body in ctes.items()}


@query("selected_pairs", check_sql("SELECT * FROM selection", "histories", **selection_sql(32, 7)))
def selected_pairs(v: Views):
    """Degree-capped greedy pairs and the seeded rest."""
    return pairs.select(v["histories"], 32, seed=7)


@query(
    "seeded_fill_pairs",
    check_sql(
        "SELECT left_id, right_id FROM draws JOIN usable USING (u) ORDER BY k LIMIT 40",
        "histories",
        usable=USABLE,
        draws=draws_sql(11, 40),
    ),
)
def seeded_fill_pairs(v: Views):
    """Pairs drawn uniformly from all usable ones."""
    members = v["histories"].select("history_id", "task_id", "has_segment")
    none = members.limit(0).select(F.col("history_id").alias("left_id"), F.col("history_id").alias("right_id"))
    return pairs.draw_pairs(members, none, 40, seed=11)


@query(
    "expanded_probe_pairs",
    check_sql(
        """SELECT left_id, right_id FROM selection_wide w WHERE NOT EXISTS (SELECT 1 FROM selection f WHERE f.left_id = w.left_id AND f.right_id = w.right_id)
        ORDER BY CASE WHEN picked_by = 'similar' THEN -similarity ELSE 1 END,
        CASE WHEN picked_by = 'similar' THEN '' ELSE md5('9|' || left_id || '|' || right_id) END, left_id, right_id LIMIT 16""",
        "histories",
        **selection_sql(8, 7), **{k: x for k, x in selection_sql(24, 9, "_wide").items() if k.endswith("_wide")},
    ),
)
def expanded_probe_pairs(v: Views):
    """Wider search after a split without a supported pair; only new pairs, capped."""
    classed = pairs.classes(v["histories"])
    first = pairs.select(v["histories"], 8, seed=7, classed=classed)
    return pairs.expand(v["histories"], first, 0, 8, cap=16, seed=9, classed=classed)
