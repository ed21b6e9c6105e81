"""Task inventory: labels, selection and hold-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.ordering import first_rows

# Family words in order of precedence, reserved families, buckets.
FAMILY_WORDS = (
    ("timezone", ("timezone", "time-zone")),
    ("late_arrivals", ("late-arriving", "incremental")),
    ("fulfillment", ("fulfillment", "shipping", "carrier")),
    ("returns", ("refund", "product-return", "fix-product-metrics")),
    ("marketing", ("attribution", "campaign", "marketing", "channel")),
    ("retention", ("cohort", "churn", "retention")),
    ("inventory", ("inventory", "warehouse", "stock", "fifo", "lifo")),
    ("customer", ("customer", "rfm", "tier", "loyalty")),
    ("finance", ("payment", "revenue", "balance", "receivable")),
    ("product", ("product", "basket", "price")),
)
RESERVED = ("fulfillment", "late_arrivals", "returns")
EXCLUDED = "timezone"
BUCKETS = ("debugging", "modeling", "analytics")
DEBUG_TAGS = ("debugging", "bug-fix")
MODEL_TAGS = ("data-modeling", "fact-table", "dimensional-modeling", "snapshot")
MODEL_CATEGORIES = ("dbt-models", "dbt-snapshots")
PAYLOAD_FIELDS = ("task_id", "instruction", "instruction_sha256", "db_type")


def family(task_id: Column) -> Column:
    """First family whose words occur in the task name, else ``other``."""
    name, ladder = F.lower(task_id), None
    for label, words in FAMILY_WORDS:
        hit = name.rlike("|".join(words))
        ladder = F.when(hit, label) if ladder is None else ladder.when(hit, label)
    return ladder.otherwise("other")


def bucket(task_id: Column, category: Column, tags: Column) -> Column:
    overlap = lambda names: F.coalesce(
        F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names])), F.lit(False)
    )
    kind = F.coalesce(category, F.lit(""))
    debugging = overlap(DEBUG_TAGS) | task_id.contains("fix-") | (kind == "debugging")
    modeling = overlap(MODEL_TAGS) | kind.isin(*MODEL_CATEGORIES)
    return F.when(debugging, "debugging").when(modeling, "modeling").otherwise("analytics")


def labelled(tasks: DataFrame) -> DataFrame:
    """Adds family, bucket and whether a task is eligible for exposure."""
    rows = tasks.withColumn("family", family(F.col("task_id"))).withColumn(
        "bucket", bucket(F.col("task_id"), F.col("category"), F.col("tags"))
    )
    return rows.withColumn("eligible", ~F.col("family").isin(EXCLUDED, *RESERVED))


def pilot(tasks: DataFrame, priority: DataFrame) -> DataFrame:
    """All eligible easy tasks and two medium ones per bucket, priority tasks first."""
    marked = tasks.filter("eligible").join(
        priority.select("task_id", F.lit(0).alias("_late")), "task_id", "left"
    ).fillna(1, ["_late"])
    easy = marked.filter(F.col("difficulty") == "easy").select(
        "task_id", F.lit(0).alias("part"), F.lit(0).alias("_late")
    )
    place = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket")).cast("int")
    medium = first_rows(
        marked.filter(F.col("difficulty") == "medium"), ["bucket"], [F.col("_late"), F.col("task_id")], 2
    ).select("task_id", place.alias("part"), "_late")
    return easy.unionByName(medium)


def source_tasks(tasks: DataFrame, priority: DataFrame, size: int) -> DataFrame:
    """``size`` tasks: the priority list without reserved ones, then pilot, then ids.

    ``priority`` has task_id and priority_rank. Fails when there are too few.
    """
    eligible = tasks.filter("eligible").select("task_id")
    listed = priority.join(eligible, "task_id", "left_semi")
    first = listed.select("task_id", F.struct(F.lit(0).alias("c"), F.col("priority_rank").cast("int").alias("p"), F.lit(0).alias("l")).alias("_k"))
    second = pilot(tasks, priority).select(
        "task_id", F.struct(F.lit(1).alias("c"), F.col("part").alias("p"), F.col("_late").alias("l")).alias("_k")
    )
    third = eligible.select("task_id", F.struct(F.lit(2).alias("c"), F.lit(0).alias("p"), F.lit(0).alias("l")).alias("_k"))
    ranked = first.unionByName(second).unionByName(third).groupBy("task_id").agg(F.min("_k").alias("_k"))
    picked = ranked.orderBy("_k", "task_id").limit(size)
    missing = size - picked.count()
    if missing > 0:
        raise ValueError(f"requested {size} source tasks, {missing} too few are eligible")
    origin = F.element_at(F.array(F.lit("priority"), F.lit("pilot"), F.lit("backfill")), F.col("_k.c") + 1)
    return picked.select("task_id", origin.alias("origin"))


def exposure(tasks: DataFrame, priority: DataFrame, size: int) -> DataFrame:
    """Every task with its role flags: pilot, source, held out, excluded, exposed.

    Removed and replacement tasks of the priority list follow from the flags.
    """
    flag = lambda df, name: df.select("task_id").distinct().withColumn(name, F.lit(True))
    rows = tasks.select("task_id", "family", "bucket", "eligible")
    for df, name in (
        (pilot(tasks, priority), "in_pilot"),
        (source_tasks(tasks, priority, size), "in_source"),
        (priority, "in_priority"),
    ):
        rows = rows.join(flag(df, name), "task_id", "left").fillna(False, [name])
    return rows.select(
        "task_id", "family", "bucket", "in_pilot", "in_source", "in_priority",
        F.col("family").isin(*RESERVED).alias("held_out"),
        (F.col("family") == EXCLUDED).alias("excluded"),
        (F.col("in_pilot") | F.col("in_source")).alias("exposed"),
        (F.col("in_source") & ~F.col("in_priority")).alias("replacement"),
        (F.col("in_priority") & ~F.col("in_source")).alias("removed"),
    )


def agent_payload(tasks: DataFrame) -> DataFrame:
    """Four allowed fields per task; held-out tasks keep their row without payload."""
    payload = F.struct(
        "task_id",
        "instruction",
        F.sha2("instruction", 256).alias("instruction_sha256"),
        F.lit("duckdb").alias("db_type"),
    )
    return tasks.select(
        "task_id", F.when(~F.col("family").isin(*RESERVED), payload).alias("agent_payload")
    )


def summary(tasks: DataFrame, roles: DataFrame, blockers: Column) -> DataFrame:
    """One row per difficulty with its count, the role counts and open blockers."""
    by_difficulty = tasks.groupBy(F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")).agg(
        F.count(F.lit(1)).alias("tasks")
    )
    totals = roles.agg(
        F.struct(
            F.count_if("in_pilot").alias("pilot_count"),
            F.count_if("in_source").alias("source_count"),
            F.count_if("held_out").alias("heldout_count"),
            F.count_if("excluded").alias("excluded_count"),
        )
    ).scalar()
    return by_difficulty.withColumn("_t", totals).select(
        "difficulty", "tasks", "_t.*", blockers.alias("launch_blockers")
    )
