"""Cross-task paths through a shared state.

A path is one observed transition into a state followed by one observed
transition out of it, from different tasks. The number of such pairs grows with
the product of both sides, so they stay factored: totals are computed from
per-task counts, and the choice of paths from the few rows of each side that can
be chosen. Judged junctions are joined from the probe bank, which is small.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import fingerprint_strings
from wayfold.operators import matching, probes as scoring
from wayfold.operators.ordering import first_per, first_rows
from wayfold.session import cut_lineage

# Equal paths are ordered by a hash of the left transition, then of the right one.
# Unlike a hash of the whole path, the least pair is found from both sides alone.
RANK = ("unsupported", "neg_variance", "neg_rollouts", "left_key", "right_key")
WITNESS = ("source_id", "target_id", "task_id", "operation", "source_state", "target_state")


def junctions(probes: DataFrame) -> DataFrame:
    """Evidence per ordered (left, right) history pair that has any probe.

    Decisions count in both directions, continuations only as judged: the full
    segment if there is one, else the local one when its scope is the full segment.
    """
    continuation = F.when(F.col("full_segment").isNotNull(), F.col("full_segment")).when(
        F.col("operation_scope") == "full_observed_segment", F.col("splice")
    )
    based = probes.withColumn("_splice", continuation)
    parts = {
        f"_{kind}_{mode}": scoring.effective_of(name, mode)
        for kind, name in (("d", "decision"), ("s", "_splice"))
        for mode in ("proxy", "grounded")
    }
    labelled = based.select(
        "probe_id", "left_id", "right_id", *[value.alias(name) for name, value in parts.items()]
    )
    exact = labelled.withColumn("_exact", F.lit(True))
    reverse = labelled.select(
        "probe_id",
        F.col("right_id").alias("left_id"),
        F.col("left_id").alias("right_id"),
        "_d_proxy", "_d_grounded",
        F.lit(None).cast("string").alias("_s_proxy"),
        F.lit(None).cast("string").alias("_s_grounded"),
        F.lit(False).alias("_exact"),
    )
    some = lambda c, label: F.coalesce(F.bool_or(F.col(c) == label), F.lit(False))
    flags = (
        exact.unionByName(reverse)
        .groupBy("left_id", "right_id")
        .agg(
            (some("_d_proxy", "contradicted")).alias("_dc"),
            (some("_d_proxy", "supported")).alias("_ds"),
            (some("_s_proxy", "contradicted")).alias("_sc"),
            (some("_s_proxy", "supported")).alias("_ss"),
            (some("_d_grounded", "supported")).alias("_dg"),
            (some("_s_grounded", "supported")).alias("_sg"),
            F.min(F.when(F.col("_exact"), F.col("probe_id"))).alias("exact_probe_id"),
            F.count_if("_exact").alias("exact_probes"),
            F.count_if(~F.col("_exact")).alias("reverse_probes"),
        )
    )
    status = (
        F.when(F.col("_dc") | F.col("_sc"), "contradicted")
        .when(F.col("_ds") & F.col("_ss"), "supported")
        .otherwise("unknown")
    )
    decision = (
        F.when(F.col("_dc"), "contradicted").when(F.col("_ds"), "supported").otherwise("unknown")
    )
    return flags.select(
        F.col("left_id").alias("left_history_id"),
        F.col("right_id").alias("right_history_id"),
        status.alias("junction_status"),
        decision.alias("decision_status"),
        F.when(F.col("_dc"), "blocked_decision_mismatch").otherwise("unassessed").alias("compilation_status"),
        F.when((status == "supported") & F.col("_dg") & F.col("_sg"), "grounded")
        .when(status == "supported", "proxy")
        .otherwise("unknown_or_contradicted")
        .alias("tier"),
        "exact_probe_id",
        "exact_probes",
        "reverse_probes",
    )


def totals(witnesses: DataFrame) -> DataFrame:
    """Cross-task paths per middle state, counted without listing them."""
    unique = witnesses.select(*WITNESS).distinct()

    def side(state: str, name: str) -> DataFrame:
        return unique.groupBy(F.col(state).alias("state_id"), "task_id").agg(
            F.count(F.lit(1)).alias(name)
        )

    per_task = side("target_state", "_in").join(
        side("source_state", "_out"), ["state_id", "task_id"], "full_outer"
    ).fillna(0, ["_in", "_out"])
    return per_task.groupBy("state_id").agg(
        F.sum("_in").alias("incoming_witnesses"),
        F.sum("_out").alias("outgoing_witnesses"),
        (F.sum("_in") * F.sum("_out") - F.sum(F.col("_in") * F.col("_out"))).alias("cross_task_paths"),
    ).filter("cross_task_paths > 0")


def _side(witnesses: DataFrame, role: str) -> DataFrame:
    state = "target_state" if role == "left" else "source_state"
    other = "source_state" if role == "left" else "target_state"
    return witnesses.select(*WITNESS).distinct().select(
        F.col(state).alias("state_id"),
        F.col("task_id").alias(f"{role}_task"),
        F.col("source_id").alias(f"{role}_source_id"),
        F.col("target_id").alias(f"{role}_target_id"),
        F.col("operation").alias(f"{role}_operation"),
        F.col(other).alias(f"{role}_other_state"),
        F.md5(F.concat_ws("|", "source_id", "target_id")).alias(f"{role}_key"),
    )


def _joined(lefts: DataFrame, rights: DataFrame) -> DataFrame:
    return lefts.join(rights, "state_id").filter(F.col("left_task") != F.col("right_task"))


def judged(witnesses: DataFrame, junction_rows: DataFrame) -> DataFrame:
    """Every path whose junction has evidence; as many rows as there is evidence."""
    middle = junction_rows.select(
        F.col("left_history_id").alias("left_target_id"), F.col("right_history_id").alias("right_source_id")
    )
    return (
        middle.join(_side(witnesses, "left"), "left_target_id")
        .join(_side(witnesses, "right"), ["state_id", "right_source_id"])
        .filter(F.col("left_task") != F.col("right_task"))
    )


def first_open(lefts: Sequence[tuple], rights: Sequence[tuple], needed: int) -> list[tuple[int, int]]:
    """Places (left, right) of the first ``needed`` paths nobody has judged, and of the first path of the first ``needed`` task pairs.

    Both sides are in order, lefts as (task, judged partners), rights as (task, history). The
    frontier reads a left row's partners on and steps over judged ones; it ends when both lists are full.
    """
    tasks = {t for t, _ in lefts} | {t for t, _ in rights}
    pairs: set[tuple] = set()
    found: list[tuple[int, int]] = []
    most_pairs = min(needed, len(tasks) * (len(tasks) - 1) // 2)
    for i, (task, judged_partners) in enumerate(lefts):
        for j, (other, history) in enumerate(rights):
            if other == task or history in judged_partners:
                continue
            pair = (task, other) if task < other else (other, task)
            fresh = len(pairs) < needed and pair not in pairs
            if fresh:
                pairs.add(pair)
            if fresh or len(found) < needed:
                found.append((i, j))
            if len(found) >= needed and len(pairs) >= most_pairs:
                return found
    return found


def _frontier(rows: DataFrame, role: str, met: DataFrame, needed: int) -> DataFrame:
    """The rows of one side that the first open paths of a state, and of its first task pairs, can be made of.

    ``met``: state, task and key of this side's rows that have judged partners at the state. A task's rows
    up to its first one without any hold its best open path with every other task; as many
    rows as are judged at the state are added to those that hold the first ``needed`` paths.
    """
    task, key = f"{role}_task", f"{role}_key"
    by_task = met.groupBy("state_id", task).agg(F.count(F.lit(1)).alias("_judged"))
    by_state = met.groupBy("state_id").agg(F.count(F.lit(1)).alias("_at_state"))
    most = needed + (by_state.agg(F.max("_at_state")).first()[0] or 0)
    rank = lambda df, keys, n: df.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(key))
    ).filter(F.col("_n") <= n)  # a constant, so that rows are left out before the shuffle
    own = rank(rows.select("state_id", task, key), ["state_id", task], most)
    counted = own.withColumnRenamed("_n", "_place").join(by_state, "state_id", "left").join(by_task, ["state_id", task], "left").fillna(0, ["_judged", "_at_state"])
    wide = F.col("_at_state") + needed
    # The first rows of the state, with room for one task that is left out, and the first rows of its first tasks.
    overall = rank(counted, ["state_id"], 2 * most).filter(F.col("_n") <= 2 * wide)
    tasks = rank(counted.filter("_place = 1"), ["state_id"], most + 2).filter(F.col("_n") <= wide + 2)
    per_task = counted.filter(F.col("_place") <= F.col("_judged") + 1).join(tasks.select("state_id", task), ["state_id", task], "left_semi")
    chosen = overall.select("state_id", key).unionByName(per_task.select("state_id", key)).distinct()
    return rows.join(chosen, ["state_id", key])


def reachable(witnesses: DataFrame, junction_rows: DataFrame, needed: int) -> DataFrame:
    """Open paths without evidence that a choice of ``needed`` per state can come to.

    Each state reads on along its two sorted sides (``first_open``). What it reads grows with the request and with the
    judged rows at the state itself, so a history with many judged partners costs its own state these partners only.
    """
    lefts, rights = _side(witnesses, "left"), _side(witnesses, "right")
    known = judged(witnesses, junction_rows)
    met = {role: known.select("state_id", f"{role}_task", f"{role}_key").distinct() for role in ("left", "right")}
    partners = known.groupBy("state_id", "left_key").agg(F.collect_set("right_source_id").alias("_partners"))
    near = _frontier(lefts, "left", met["left"], needed).join(partners, ["state_id", "left_key"], "left")
    far = _frontier(rights, "right", met["right"], needed)
    schema = _joined(lefts, rights).schema

    def read_on(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("left_key"), right.sort_values("right_key")
        partners = [frozenset(p) if p is not None else frozenset() for p in left["_partners"]]
        found = first_open(list(zip(left["left_task"], partners)), list(zip(right["right_task"], right["right_source_id"])), needed)
        one = left.drop(columns="_partners").iloc[[i for i, _ in found]].reset_index(drop=True)
        other = right.drop(columns="state_id").iloc[[j for _, j in found]].reset_index(drop=True)
        return pd.concat([one, other], axis=1)[schema.names]

    return near.groupBy("state_id").cogroup(far.groupBy("state_id")).applyInPandas(read_on, schema)


def _with_evidence(paths: DataFrame, junction_rows: DataFrame, outcome: DataFrame) -> DataFrame:
    evidence = junction_rows.withColumnsRenamed(
        {"left_history_id": "left_target_id", "right_history_id": "right_source_id"}
    )
    stats = outcome.select("state_id", "pooled_binary_variance", "distinct_rollouts")
    rows = paths.join(evidence, ["left_target_id", "right_source_id"], "left").join(stats, "state_id", "left")
    variance = F.coalesce("pooled_binary_variance", F.lit(0.0))
    ids = [f"{side}_{end}_id" for side in ("left", "right") for end in ("source", "target")]
    return rows.fillna(
        {
            "junction_status": "unknown",
            "decision_status": "unknown",
            "compilation_status": "unassessed",
            "tier": "unknown_or_contradicted",
            "exact_probes": 0,
            "reverse_probes": 0,
        }
    ).select(
        F.concat(F.lit("cross-task-"), F.substring(fingerprint_strings(*ids), 1, 12)).alias("path_id"),
        F.col("state_id").alias("target_state"),
        F.concat_ws("|", F.least("left_task", "right_task"), F.greatest("left_task", "right_task")).alias("task_pair"),
        *[c for c in paths.columns if c != "state_id"],
        "junction_status", "decision_status", "compilation_status", "tier",
        "exact_probe_id", "exact_probes", "reverse_probes",
        "pooled_binary_variance",
        "distinct_rollouts",
        F.when(variance > 0, "positive pooled outcome variance")
        .otherwise("high-support fallback; no positive variance for this node")
        .alias("selection_reason"),
        F.when(F.col("junction_status") == "supported", 0).otherwise(1).alias("unsupported"),
        (-variance).alias("neg_variance"),
        (-F.coalesce("distinct_rollouts", F.lit(0))).alias("neg_rollouts"),
    )


def _settled(witnesses: DataFrame, junction_rows: DataFrame, outcome: DataFrame):
    """Inputs of the choice, computed once; each is read by several branches."""
    unique = witnesses.select(*WITNESS).distinct()
    return cut_lineage(unique), cut_lineage(junction_rows), cut_lineage(outcome)


def _degree(junction_rows: DataFrame) -> int:
    """Largest number of judged partners of one history (one driver row)."""
    ends = junction_rows.select(F.explode(F.array("left_history_id", "right_history_id")).alias("h"))
    row = ends.groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return int(row["n"] or 0)


def candidates(
    witnesses: DataFrame, junction_rows: DataFrame, outcome: DataFrame, limit: int
) -> DataFrame:
    """Judged paths plus every other path a choice of ``limit`` can come to, ranked."""
    rows = reachable(witnesses, junction_rows, 2 * limit + 2)
    both = rows.unionByName(judged(witnesses, junction_rows).select(rows.columns)).distinct()
    return _with_evidence(both, junction_rows, outcome)


def best_per_task_pair(witnesses: DataFrame, junction_rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """The first open path of every state and task pair.

    Heads of each (state, task) meet task by task, one row per history at the state.
    A history is blocked with at most ``spare`` partners, so that many rows besides
    the first hold an open path if there is any; supported paths come from the
    evidence itself.
    """
    witnesses, junction_rows, outcome = _settled(witnesses, junction_rows, outcome)
    blocked = F.col("compilation_status") == "blocked_decision_mismatch"
    spare = _degree(junction_rows.filter(blocked))
    sides = []
    for role, end in (("left", "target"), ("right", "source")):
        group = ["state_id", f"{role}_task"]
        rows = first_per(_side(witnesses, role), [*group, f"{role}_{end}_id"], [f"{role}_key", f"{role}_operation"])
        sides.append(first_rows(rows, group, [F.col(f"{role}_key")], spare + 1))
    lefts, rights = sides
    heads = _joined(lefts, rights)
    both = heads.unionByName(judged(witnesses, junction_rows).select(heads.columns)).distinct()
    open_paths = _with_evidence(both, junction_rows, outcome).filter(~blocked)
    return first_per(open_paths, ["target_state", "task_pair"], list(RANK))


def cross_task(
    witnesses: DataFrame, junction_rows: DataFrame, outcome: DataFrame, limit: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(selected paths, ledger of paths blocked by a contradicted decision)."""
    witnesses, junction_rows, outcome = _settled(witnesses, junction_rows, outcome)
    blocked = _with_evidence(judged(witnesses, junction_rows), junction_rows, outcome).filter(
        F.col("compilation_status") == "blocked_decision_mismatch"
    )
    open_paths = candidates(witnesses, junction_rows, outcome, limit).filter(
        F.col("compilation_status") != "blocked_decision_mismatch"
    )
    return matching.diverse(cut_lineage(open_paths), "target_state", "task_pair", RANK, limit), blocked


def unjudged_shortlist(
    witnesses: DataFrame, junction_rows: DataFrame, outcome: DataFrame, size: int = 3
) -> DataFrame:
    """First distinct junctions of unknown status in the diverse order of paths."""
    witnesses, junction_rows, outcome = _settled(witnesses, junction_rows, outcome)
    limit = 4 * size
    while True:
        unknown = candidates(witnesses, junction_rows, outcome, limit).filter(
            (F.col("junction_status") == "unknown") & (F.col("compilation_status") == "unassessed")
        )
        ordered = cut_lineage(
            matching.diverse(cut_lineage(unknown), "target_state", "task_pair", RANK, limit)
        )
        order = ["pass", *RANK]
        first = first_per(
            ordered.select("left_target_id", "right_source_id", *[c for c in order if c not in ("left_target_id", "right_source_id")]),
            ["left_target_id", "right_source_id"],
            [c for c in order if c not in ("left_target_id", "right_source_id")],
        )
        if ordered.count() < limit or first.count() >= size:
            return first.orderBy(*order).limit(size).select("left_target_id", "right_source_id", "pass")
        limit *= 4


def enrich(selected: DataFrame, definitions: DataFrame, prefixes: DataFrame, effects: DataFrame, limit: int) -> DataFrame:
    """State definition, both junction prefixes and segment effects of chosen paths.

    At most ``limit`` paths are chosen, so their ids are broadcast to cut the large
    tables down first.
    """
    few = selected.limit(limit)

    def looked_up(table: DataFrame, keys: list[str]) -> DataFrame:
        wanted = F.broadcast(few.select(*keys).distinct())
        return table.join(wanted, keys, "left_semi")

    left = prefixes.select(F.col("history_id").alias("left_target_id"), F.col("prefix").alias("junction_prefix_a"))
    right = prefixes.select(F.col("history_id").alias("right_source_id"), F.col("prefix").alias("junction_prefix_b"))
    defs = definitions.select(F.col("state_id").alias("target_state"), "description")
    out = few
    for table, key in ((defs, "target_state"), (left, "left_target_id"), (right, "right_source_id")):
        out = out.join(looked_up(table, [key]), key, "left")
    for role in ("left", "right"):
        names = {"source_id": f"{role}_source_id", "target_id": f"{role}_target_id", "effect": f"{role}_effect"}
        ends = [f"{role}_source_id", f"{role}_target_id"]
        out = out.join(looked_up(effects.select(*names).withColumnsRenamed(names), ends), ends, "left")
    return out


def exact_judgments(paths: DataFrame, judgments: DataFrame) -> DataFrame:
    """Saved judgments of a path's own probe and direction, with all three labels.

    A reversed pair never stands in for the exact one.
    """
    complete = judgments.filter(
        F.col("decision_label").isNotNull() & F.col("local_label").isNotNull() & F.col("full_label").isNotNull()
    )
    keyed = paths.select(
        "path_id",
        F.col("exact_probe_id").alias("probe_id"),
        F.col("left_target_id").alias("left_id"),
        F.col("right_source_id").alias("right_id"),
    )
    return keyed.join(complete, ["probe_id", "left_id", "right_id"])


def work_queue(
    paths: DataFrame, ledger: DataFrame, judgments: DataFrame, order: list[str], maximum: int
) -> DataFrame:
    """Open paths, one per target and task pair, with the state of each.

    Terminal entries of the ledger are skipped; without an exact judgment the
    path waits for one, and a contradicted decision cannot be compiled.
    """
    done = ledger.filter(
        F.col("status").isin("validated", "unsupported_target", "construction_failed", "awaiting_runtime_validation")
    )
    fresh = paths.join(done.select("path_id").distinct(), "path_id", "left_anti")
    one_each = first_rows(fresh, ["target_state", "task_pair"], [F.col(c) for c in order], 1)
    queue = one_each.orderBy(*order).limit(maximum)
    found = (
        exact_judgments(queue, judgments)
        .groupBy("path_id")
        .agg(F.bool_or(F.col("decision_label") == "contradicted").alias("_contradicted"))
    )
    return queue.join(found, "path_id", "left").withColumn(
        "queue_status",
        F.when(F.col("_contradicted").isNull(), "needs_original_junction_judgment")
        .when(F.col("_contradicted"), "unsupported_target")
        .otherwise("ready"),
    ).drop("_contradicted")


def segment_receipts(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """Looks up the recorded segment of a chosen transition and says what is wrong.

    ``requests``: request_id, witness_ref, source_id, target_id. ``segments``:
    witness_ref, source_id, target_id, executed (number of confirmed episodes).
    """
    recorded = segments.select(
        "witness_ref",
        F.col("source_id").alias("_source"),
        F.col("target_id").alias("_target"),
        "executed",
    )
    joined = requests.join(recorded, "witness_ref", "left")
    reason = (
        F.when(F.col("_source").isNull(), "segment missing")
        .when((F.col("_source") != F.col("source_id")) | (F.col("_target") != F.col("target_id")), "histories differ")
        .when(F.col("executed") < 1, "no confirmed episode")
        .otherwise("ok")
    )
    return joined.select("request_id", "witness_ref", reason.alias("receipt"))


def shared_start(
    judgments: DataFrame, histories: DataFrame, witnesses: DataFrame, segments: DataFrame
) -> DataFrame:
    """Every judged pair with the first reason against it, or ``Eligible``.

    Two histories at step 0 of different tasks, in the same state, each with
    exactly one outgoing witness that matches its segment.
    """
    outgoing = witnesses.groupBy(F.col("source_id").alias("history_id")).agg(
        F.count(F.lit(1)).alias("out"),
        F.min("source_state").alias("state"),
        F.min("target_id").alias("next_id"),
        F.min("witness_ref").alias("ref"),
    )
    recorded = segments.select(
        F.col("witness_ref").alias("ref"),
        F.col("source_id").alias("seg_source"),
        F.col("target_id").alias("seg_target"),
    )
    starts = (
        histories.select("history_id", "task_id", "step")
        .join(outgoing, "history_id", "left")
        .join(recorded, "ref", "left")
        .drop("ref")
    )

    def side(name: str) -> DataFrame:
        return starts.select(*[F.col(c).alias(f"{name}_{c}") for c in starts.columns])

    rows = judgments.join(
        side("l"), F.col("left_id") == F.col("l_history_id"), "left"
    ).join(side("r"), F.col("right_id") == F.col("r_history_id"), "left")
    both = lambda test: test("l") & test("r")
    ladder = (
        F.when(
            ~((F.col("decision_label") == "supported") & (F.col("local_label") == "supported")),
            "decision and local transfer support both required",
        )
        .when(
            ~both(lambda s: F.coalesce(F.col(f"{s}_step") == 0, F.lit(False))),
            "both histories must be initial",
        )
        .when(F.col("l_task_id") == F.col("r_task_id"), "distinct source tasks required")
        .when(
            ~both(lambda s: F.coalesce(F.col(f"{s}_out"), F.lit(0)) == 1),
            "one observed first segment per history required",
        )
        .when(F.col("l_state") != F.col("r_state"), "both histories must share a state")
        .when(~both(lambda s: F.col(f"{s}_seg_source").isNotNull()), "observed segment missing")
        .when(
            ~both(
                lambda s: (F.col(f"{s}_seg_source") == F.col(f"{s}_history_id"))
                & (F.col(f"{s}_seg_target") == F.col(f"{s}_next_id"))
            ),
            "graph and segment identities differ",
        )
        .otherwise("Eligible")
    )
    return rows.select(
        "probe_id", "left_id", "right_id",
        F.col("l_task_id").alias("left_task"), F.col("r_task_id").alias("right_task"),
        F.col("l_state").alias("target_state"),
        ladder.alias("eligibility"),
    )


def shared_start_selection(
    rows: DataFrame, limit: int = 3, probe_ids: list[str] | None = None
) -> DataFrame:
    """One eligible pair per two tasks, training probes first; or the named probes."""
    if probe_ids is not None:
        if not probe_ids or len(set(probe_ids)) != len(probe_ids):
            raise ValueError("explicit probe ids must be nonempty and unique")
        named = rows.filter(F.col("probe_id").isin(*probe_ids))
        return named.withColumn(
            "eligibility",
            F.when(F.col("eligibility") == "Eligible", F.col("eligibility")).otherwise(
                F.raise_error(F.concat(F.lit("ineligible probe "), "probe_id", F.lit(": "), "eligibility"))
            ),
        )
    if limit < 1:
        raise ValueError("limit must be positive")
    eligible = rows.filter("eligibility = 'Eligible'").select(
        F.when(F.col("probe_id").startswith("train-"), 0).otherwise(1).alias("_late"),
        "probe_id", "left_id", "right_id", "left_task", "right_task", "target_state",
        F.least("left_task", "right_task").alias("task_a"),
        F.greatest("left_task", "right_task").alias("task_b"),
    )
    picked = first_per(eligible, ["task_a", "task_b"], ["_late", "probe_id"])
    return picked.orderBy("_late", "probe_id").limit(limit).drop("_late")
