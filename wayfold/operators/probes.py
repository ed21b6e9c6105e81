"""Scoring of state assignments against a frozen bank of judged pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import evidence
from wayfold.functions.text import row_number_word

# Score of every status.
SCORES = {"valid": 1.0, "invalid": -4.0, "unknown": 0.0, "not_connected": 0.0}
STATUSES = tuple(SCORES)


def tier_of(name: str) -> Column:
    part = F.col(name)
    return evidence.tier(part["label"], part["method"], part["independent"], part["audited"])


def effective_of(name: str, mode: Column | str) -> Column:
    return evidence.effective(F.col(name)["label"], tier_of(name), mode)


def status(offered: Column, decision: Column, splice: Column) -> Column:
    joint = evidence.joint(decision, splice)
    return (
        F.when(~offered, "not_connected")
        .when(joint == "contradicted", "invalid")
        .when(joint == "supported", "valid")
        .otherwise("unknown")
    )


def score_of(status_col: Column) -> Column:
    return F.when(status_col == "valid", 1.0).when(status_col == "invalid", -4.0).otherwise(0.0)


def offered_pairs(probes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Probes with the states of both ends, per candidate when there are several.

    A missing state never equals another missing state. A probe end without any assignment
    stops the job: leaving the probe out would shrink the denominator. The candidates are the
    few groupings under comparison; only their names are read on the driver.
    """
    by = ["candidate_id"] if "candidate_id" in assignments.columns else []
    if by:
        names = sorted(r[0] for r in assignments.select("candidate_id").distinct().collect())
        probes = probes.withColumn("candidate_id", F.explode(F.array(*map(F.lit, names))))
    ends = {
        side: assignments.select(
            *by, F.col("history_id").alias(f"{side}_id"), F.col("state_id").alias(f"{side}_state"), F.lit(True).alias(f"_{side}")
        )
        for side in ("left", "right")
    }
    joined = probes.join(ends["left"], [*by, "left_id"], "left").join(ends["right"], [*by, "right_id"], "left")
    absent = F.col("_left").isNull() | F.col("_right").isNull()
    message = F.concat(F.lit("no assignment for an end of the probe "), F.col("left_id"), F.lit(" / "), F.col("right_id"))
    same = F.coalesce(F.col("left_state") == F.col("right_state"), F.lit(False))
    return joined.withColumn("offered", F.when(absent, F.raise_error(message)).otherwise(same)).drop("_left", "_right")


def score(probes: DataFrame, assignments: DataFrame, mode: str = "proxy") -> DataFrame:
    """One row per probe (and candidate): status, score, labels under the mode, tiers."""
    rows = (
        offered_pairs(probes, assignments)
        .withColumn("decision_label", effective_of("decision", mode))
        .withColumn("splice_label", effective_of("splice", mode))
        .withColumn("decision_tier", tier_of("decision"))
        .withColumn("splice_tier", tier_of("splice"))
        .withColumn("status", status(F.col("offered"), F.col("decision_label"), F.col("splice_label")))
    )
    return rows.withColumn("score", score_of(F.col("status")))


def summarize(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Status counts, the fixed denominator and the mean score."""
    totals = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    measures = [*totals, F.count(F.lit(1)).alias("denominator"), F.sum("score").alias("_sum")]
    grouped = results.groupBy(*by).agg(*measures) if by else results.agg(*measures)
    mean = F.when(F.col("denominator") > 0, F.col("_sum") / F.col("denominator")).otherwise(
        F.raise_error(F.lit("cannot score an empty set of probes"))
    )
    return grouped.withColumn("mean_score", mean).drop("_sum")


def summarize_modes(probes: DataFrame, assignments: DataFrame) -> DataFrame:
    """The summary under every evidence mode, from one pass over the pairs."""
    rows = offered_pairs(probes, assignments)
    by = ["candidate_id"] if "candidate_id" in assignments.columns else []
    measures = [F.count(F.lit(1)).alias("_all")]
    for mode in evidence.MODES:
        rows = rows.withColumn(
            f"_{mode}",
            status(F.col("offered"), effective_of("decision", mode), effective_of("splice", mode)),
        )
        measures += [F.count_if(F.col(f"_{mode}") == s).alias(f"{mode}_{s}") for s in STATUSES]
    wide = rows.groupBy(*by).agg(*measures) if by else rows.agg(*measures)
    per_mode = F.array(*[
        F.struct(
            F.lit(mode).alias("mode"),
            *[F.col(f"{mode}_{s}").alias(s) for s in STATUSES],
            F.col("_all").alias("denominator"),
        )
        for mode in evidence.MODES
    ])
    flat = wide.select(*by, F.explode(per_mode).alias("_m")).select(*by, "_m.*")
    total = F.col("valid") - 4 * F.col("invalid")
    return flat.withColumn("mean_score", total / F.col("denominator"))


def joint_counts(probes: DataFrame, split: str, mode: str = "proxy") -> DataFrame:
    """Jointly supported, contradicted and unknown probes per split, and the total."""
    label = evidence.joint(effective_of("decision", mode), effective_of("splice", mode))
    counted = [F.count_if(label == name).alias(name) for name in evidence.LABELS]
    return probes.groupBy(split).agg(*counted, F.count(F.lit(1)).alias("total"))


def leaderboard(
    candidates: DataFrame,
    assignments: DataFrame,
    probes: DataFrame,
    mode: str = "proxy",
    subset: Column | None = None,
) -> DataFrame:
    """Every candidate over the same bank, best first, earliest wins ties.

    ``candidates`` has candidate_id, candidate_index, valid. An invalid candidate
    scores -4 on every probe; it cannot remove cases. The score on a requested
    subset is kept apart from the score on the whole bank.
    """
    chosen = F.lit(True) if subset is None else subset
    bank = probes.withColumn("in_subset", chosen)
    sizes = bank.agg(
        F.struct(
            F.count(F.lit(1)).alias("bank"), F.count_if("in_subset").alias("subset")
        )
    ).scalar()
    scored = score(bank, assignments, mode)
    sums = scored.groupBy("candidate_id").agg(
        F.sum("score").alias("_sum"),
        F.sum(F.when(F.col("in_subset"), F.col("score"))).alias("_subset_sum"),
        F.count(F.lit(1)).alias("scored_probes"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_probes") for s in STATUSES],
    )
    rows = candidates.join(sums, "candidate_id", "left").withColumn("_size", sizes)
    mean = F.when(F.col("valid"), F.col("_sum") / F.col("_size.bank")).otherwise(-4.0)
    subset_mean = F.when(F.col("valid"), F.col("_subset_sum") / F.col("_size.subset")).otherwise(-4.0)
    return rows.select(
        "candidate_id",
        "candidate_index",
        "valid",
        *[
            F.when(F.col("valid"), F.coalesce(f"{s}_probes", F.lit(0))).otherwise(0).alias(f"{s}_probes")
            for s in ("scored", *STATUSES)
        ],
        F.col("_size.bank").alias("denominator"),
        mean.alias("mean_score"),
        subset_mean.alias("subset_score"),
    )


def best(board: DataFrame) -> DataFrame:
    order = F.struct((-F.col("mean_score")).alias("a"), F.col("candidate_index").alias("b"))
    return board.agg(
        F.min_by("candidate_id", order).alias("best_candidate"),
        F.max("mean_score").alias("best_score"),
        F.count(F.lit(1)).alias("candidates"),
    )


def bank_fingerprint(probes: DataFrame, id_col: str = "probe_id") -> DataFrame:
    """One hash for a whole bank, independent of row order and partitioning.

    Row hashes cover the probe id and every field; their sum identifies the set
    without bringing the rows together.
    """
    names = [id_col] + sorted(c for c in probes.columns if c != id_col)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in names]
    text = F.concat_ws("\u001f", *parts)
    words = probes.select(
        row_number_word(F.concat(F.lit("a"), text)).cast("decimal(38,0)").alias("a"),
        row_number_word(F.concat(F.lit("b"), text)).cast("decimal(38,0)").alias("b"),
    )
    summed = words.agg(
        F.count(F.lit(1)).alias("probes"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    packed = F.concat_ws("|", F.col("probes").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return summed.select("probes", F.sha2(packed, 256).alias("bank_sha256"))
