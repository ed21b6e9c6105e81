"""Comparison of query results, document diffs and staged workflow checks."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions.cells import is_numeric, typed_columns
from wayfold.operators.ordering import positions
from wayfold.operators.pairing import cell, close, most_pairs
from wayfold.session import cut_lineage

# Row limit and stage names of the published protocol.
MAX_RESULT_ROWS, SAMPLE_ROWS = 1000, 3
STAGE_NAME = r"sg_[a-z0-9_]+"


def _report(spark: SparkSession, matches: bool, reason: str, rows: int | None = None, wanted: int | None = None) -> DataFrame:
    return spark.range(1).select(
        F.lit(matches).alias("matches"),
        F.lit(reason).alias("reason"),
        F.lit(rows).cast("long").alias("actual_rows"),
        F.lit(wanted).cast("long").alias("expected_rows"),
    )


def _sided(actual: DataFrame, expected: DataFrame) -> DataFrame:
    a = actual.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
    b = expected.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    return a.unionByName(b)


def multiset(
    actual: DataFrame, expected: DataFrame, ordered_by: str | None = None
) -> DataFrame:
    """One row: matches, reason, actual_rows, expected_rows.

    Same column names in order and the same rows as often, over typed cells. With
    ``ordered_by`` (a unique number per row) the sequences have to be equal; the
    order column itself is not compared.
    """
    names = [c for c in actual.columns if c != ordered_by]
    if names != [c for c in expected.columns if c != ordered_by]:
        return _report(actual.sparkSession, False, "column names/order differ")
    if ordered_by is None:
        sided = _sided(actual.select(*typed_columns(actual)), expected.select(*typed_columns(expected)))
        counted = sided.groupBy(*names).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
        totals = counted.agg(
            F.count_if(F.col("_a") != F.col("_b")).alias("_bad"),
            F.coalesce(F.sum("_a"), F.lit(0)).alias("actual_rows"),
            F.coalesce(F.sum("_b"), F.lit(0)).alias("expected_rows"),
        )
    else:
        def placed(df: DataFrame, side: str) -> DataFrame:
            cells = typed_columns(df.select(*names))
            rows = df.select(F.col(ordered_by).alias("_order"), F.struct(*cells).alias(side))
            return positions(rows, [], "_order").select("pos", side)

        joined = placed(actual, "_a").join(placed(expected, "_b"), "pos", "full_outer")
        totals = joined.agg(
            F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("_bad"),
            F.count("_a").alias("actual_rows"),
            F.count("_b").alias("expected_rows"),
        )
    match = F.col("_bad") == 0
    return totals.select(
        match.alias("matches"),
        F.when(match, "equal").otherwise("row values/multiplicities differ").alias("reason"),
        "actual_rows",
        "expected_rows",
    )


def multiset_difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """The differing rows with their counts on both sides."""
    names = actual.columns
    sided = _sided(actual.select(*typed_columns(actual)), expected.select(*typed_columns(expected)))
    counted = sided.groupBy(*names).agg(
        F.sum("_a").alias("actual_count"), F.sum("_b").alias("expected_count")
    )
    return counted.filter("actual_count <> expected_count")


#: Close pairs that may hang together and be solved in one task.
MAX_CLUSTER = 1_000_000
#: Pairs of rows per row that a grid cell may hold before a single numeric column is compared in sorted order instead.
DENSE = 64


def _split_cells(df: DataFrame) -> tuple[list[str], list[str]]:
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    return numeric, [c for c in df.columns if c not in numeric]


def _keyed(df: DataFrame, extra: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Rows as (extra, _key of the exact cells, _n0.. numeric cells as doubles)."""
    body = df.drop(*extra)
    numeric, other = _split_cells(body)
    cells = typed_columns(body.select(*other)) if other else [F.lit("").alias("_none")]
    exact = df.select(*extra, F.struct(*cells).alias("_exact"), *numeric)
    key = F.sha2(F.to_json("_exact"), 256)
    names = [f"_n{i}" for i in range(len(numeric))]
    return (
        exact.select(*extra, key.alias("_key"), *[
            F.col(c).cast("double").alias(n) for c, n in zip(numeric, names, strict=True)
        ]),
        names,
    )


def _misplaced(counted: DataFrame, name: str) -> Column:
    """Whether the sorted values of both sides fail to pair inside some group of equal other cells."""
    sides = []
    for flag in ("_a", "_b"):
        listed = counted.filter(F.col(flag) > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(flag).cast("int"))))
        placed = positions(listed.select("_key", name), ["_key"], name)
        sides.append(placed.select("_key", "pos", F.struct(name).alias(flag)))
    joined = sides[0].join(sides[1], ["_key", "pos"], "full_outer")
    good = F.col("_a").isNotNull() & F.col("_b").isNotNull() & close(F.col(f"_a.{name}"), F.col(f"_b.{name}"))
    return joined.agg(F.coalesce(F.bool_or(~F.coalesce(good, F.lit(False))), F.lit(False))).first()[0]


def _is_dense(counted: DataFrame, name: str) -> bool:
    """Whether many rows of both sides share the cells of a column, so that their pairs would be too many."""
    met = counted.groupBy("_key", cell(F.col(name))).agg(F.count_if(F.col("_a") > 0).alias("l"), F.count_if(F.col("_b") > 0).alias("r"))
    pairs, rows = met.agg(F.sum(F.col("l") * F.col("r")), F.sum(F.col("l") + F.col("r"))).first()
    return (pairs or 0) > DENSE * (rows or 0)


def tolerant(actual: DataFrame, expected: DataFrame, order_by: Sequence[str] = (), max_cluster: int = MAX_CLUSTER) -> DataFrame:
    """Multiset comparison with numeric tolerance; report row as in ``multiset``.

    Rows match if their other cells are equal and all numeric ones close (a null only to a null, NaN and
    infinities to themselves). The results match if their rows can be paired one to one, whichever rows
    that takes (see ``pairing``). A single numeric column with many rows to a cell is paired in sorted order,
    which finds a pairing whenever there is one. With several numeric columns, more than
    ``max_cluster`` close pairs that hang together raise an error instead of a guess. With ``order_by``
    both sides are sequences in the order of these columns (then of the others) and compared place by place.
    """
    if actual.columns != expected.columns:
        return _report(actual.sparkSession, False, "column mismatch")
    kinds = lambda df: [is_numeric(f.dataType) for f in df.schema.fields]
    if kinds(actual) != kinds(expected):
        return _report(actual.sparkSession, False, "column mismatch")
    if order_by:
        return _in_sequence(actual, expected, list(order_by))
    left, names = _keyed(actual)
    right, _ = _keyed(expected)
    counted = cut_lineage(
        _sided(left, right).groupBy("_key", *names).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    )
    rows, wanted, uneven = counted.agg(
        F.coalesce(F.sum("_a"), F.lit(0)), F.coalesce(F.sum("_b"), F.lit(0)), F.count_if(F.col("_a") != F.col("_b"))
    ).first()
    if rows != wanted:
        reason = "row count mismatch"
    elif not uneven:
        reason = "equal"
    elif not names:
        reason = "result differs; missing row"
    elif len(names) == 1 and _is_dense(counted, names[0]):
        reason = "result differs; missing row" if _misplaced(counted, names[0]) else "equal"
    else:
        side = lambda flag: counted.filter(F.col(flag) > 0).select("_key", *names, F.col(flag).alias("n"))
        hits = most_pairs(side("_a"), side("_b"), [], names, max_cluster).first()["hits"]
        reason = "equal" if hits == rows else "result differs; missing row"
    return _report(actual.sparkSession, reason == "equal", reason, rows, wanted)


def _in_sequence(actual: DataFrame, expected: DataFrame, order: list[str]) -> DataFrame:
    """Tolerant comparison of the rows at equal places."""
    rest = [c for c in actual.columns if c not in order]
    sides = []
    for df, flag in ((actual, "_a"), (expected, "_b")):
        placed = positions(df, [], order[0], [*order[1:], *rest])
        keyed, names = _keyed(placed.drop("group_rows"), ["pos"])
        sides.append(keyed.select("pos", F.struct("_key", *names).alias(flag)))
    good = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a._key") == F.col("_b._key"))
    for name in names:
        good = good & close(F.col(f"_a.{name}"), F.col(f"_b.{name}"))
    joined = sides[0].join(sides[1], "pos", "full_outer")
    totals = joined.agg(
        F.count("_a").alias("actual_rows"), F.count("_b").alias("expected_rows"), F.count_if(~F.coalesce(good, F.lit(False))).alias("_bad")
    )
    reason = F.when(F.col("actual_rows") != F.col("expected_rows"), "row count mismatch").when(F.col("_bad") > 0, "ordered result differs")
    return totals.select(
        (F.col("_bad") == 0).alias("matches"), reason.otherwise("equal").alias("reason"), "actual_rows", "expected_rows"
    )


def set_difference(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, side): ``extra`` where only found, ``missing`` where only wanted."""
    extra = found.select(key).subtract(wanted.select(key)).withColumn("side", F.lit("extra"))
    missing = wanted.select(key).subtract(found.select(key)).withColumn("side", F.lit("missing"))
    return extra.unionByName(missing)


def differences(before: str | None, after: str | None) -> list[tuple[str, str | None, str | None]]:
    """(path, before, after) of two JSON texts: objects key by key, everything else as a whole."""

    def read(text: str | None):
        try:
            return None if text is None else json.loads(text)
        except (ValueError, RecursionError):
            return None

    write = lambda v: None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    found, waiting = [], [("", read(before), read(after))]
    while waiting:
        path, a, b = waiting.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            waiting += [(f"{path}/{key}", a.get(key), b.get(key)) for key in sorted(a.keys() | b.keys(), reverse=True)]
        elif a != b:
            found.append((path, write(a), write(b)))
    return found


def document_diff(documents: DataFrame, doc_id: str, before: str, after: str) -> DataFrame:
    """(doc_id, path, before, after) of two JSON texts per row.

    Objects are compared key by key to any depth inside the row, in one pass over the table; everything
    else as a whole. A missing key equals an explicit null, and so does a text that is no JSON.
    """

    def compare(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([
            [{"path": p, "before": x, "after": y} for p, x, y in differences(a, b)] for a, b in zip(left, right, strict=True)
        ])

    changed = F.pandas_udf(compare, "array<struct<path:string,before:string,after:string>>")(F.col(before), F.col(after))
    return documents.select(F.col(doc_id), F.inline(changed))


def grade(
    expected: DataFrame,
    submissions: DataFrame,
    constraints: Mapping[str, Column] | None = None,
    *,
    ids: DataFrame | None = None,
    order_by: Sequence[str] = (),
    max_rows: int | None = None,
    max_cluster: int = MAX_CLUSTER,
) -> DataFrame:
    """Grades every submission in one job: (submission_id, reward, reason, rows).

    ``submissions`` has submission_id and the columns of ``expected``; a
    constraint is a boolean aggregate over the rows of one submission. ``ids`` lists all submissions,
    so that one without rows is graded too: as a wrong row count, or, where nothing is expected, by its
    constraints, which are null over no rows and then fail. Rows pair as in ``tolerant``, with
    ``order_by`` place by place. Only submissions of the right size are compared row by row;
    ``max_rows`` refuses longer ones, by default none.
    """
    columns = expected.columns
    if columns != [c for c in submissions.columns if c != "submission_id"]:
        raise ValueError("submissions must have the expected columns after submission_id")
    constraints = constraints or {}
    size = expected.agg(F.count(F.lit(1))).scalar()
    flags = {f"_c{i}": test for i, test in enumerate(constraints.values())}
    stats = submissions.groupBy("submission_id").agg(F.count(F.lit(1)).alias("rows"), *[test.alias(n) for n, test in flags.items()])
    if ids is not None:
        stats = ids.select("submission_id").distinct().join(stats, "submission_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    stats = stats.withColumn("_expected", size)
    long = F.lit(False) if max_rows is None else F.col("rows") > max_rows
    sized = stats.filter((F.col("rows") == F.col("_expected")) & ~long).select("submission_id")
    rows = submissions.join(sized, "submission_id", "left_semi")
    if order_by:
        hits = _hits_in_sequence(rows, expected, list(order_by))
    else:
        placed, names = _keyed(rows, ["submission_id"])
        frozen, _ = _keyed(expected)
        left = placed.groupBy("submission_id", "_key", *names).agg(F.count(F.lit(1)).alias("n"))
        right = frozen.groupBy("_key", *names).agg(F.count(F.lit(1)).alias("n"))
        hits = most_pairs(left, right, ["submission_id"], names, max_cluster)
    graded = stats.join(hits.withColumnRenamed("hits", "_hits"), "submission_id", "left")
    reason = F.when(long, "too many rows").when(
        F.col("rows") != F.col("_expected"), "row count mismatch"
    ).when(F.coalesce("_hits", F.lit(0)) < F.col("_expected"), "result differs")
    for (name, _), flag in zip(constraints.items(), flags, strict=True):
        reason = reason.when(~F.coalesce(F.col(flag), F.lit(False)), f"constraint fails: {name}")
    return graded.withColumn("reason", reason.otherwise("pass")).select(
        "submission_id",
        F.when(F.col("reason") == "pass", 1).otherwise(0).alias("reward"),
        "reason",
        "rows",
    )


def _hits_in_sequence(rows: DataFrame, expected: DataFrame, order: list[str]) -> DataFrame:
    """(submission_id, hits): rows of each submission that match the expected row at their place."""
    rest = [c for c in expected.columns if c not in order]
    placed, names = _keyed(positions(rows, ["submission_id"], order[0], [*order[1:], *rest]).drop("group_rows"), ["submission_id", "pos"])
    frozen, _ = _keyed(positions(expected, [], order[0], [*order[1:], *rest]).drop("group_rows"), ["pos"])
    frozen = frozen.select("pos", F.col("_key").alias("_ekey"), *[F.col(n).alias(f"e{n}") for n in names])
    near = F.col("_key") == F.col("_ekey")
    for name in names:
        near = near & close(F.col(name), F.col(f"e{name}"))
    return placed.join(frozen, "pos").filter(near).groupBy("submission_id").agg(F.count(F.lit(1)).alias("hits"))


def _mentions(sql: str, name: str) -> bool:
    return bool(re.search(r"\b" + re.escape(name) + r"\b", sql, re.IGNORECASE))


def workflow_shape(spec: Mapping) -> list[str]:
    """Breaches of the form of a staged workflow, without running it.

    Where the spec lists ``transitions`` (id -> source task), every stage cites some of them, and all
    stages together those of two source tasks at least.
    """
    stages, found = spec.get("stages", []), []
    names = [s.get("name", "") for s in stages]
    if len(stages) < 2:
        found.append("at least two stages are required")
    if len(set(names)) != len(names) or any(
        not re.fullmatch(STAGE_NAME, n) or n == "sg_result" for n in names
    ):
        found.append("stage names must be unique sg_ identifiers")
    for previous, stage in zip(stages, stages[1:], strict=False):
        if not _mentions(stage["sql"], previous["name"]):
            found.append(f"stage {stage['name']} must read {previous['name']}")
    known = spec.get("transitions")
    if known is not None:
        cited = [t for s in stages for t in s.get("source_transition_ids", ())]
        found += [
            f"stage {s.get('name')} must cite known transitions" for s in stages
            if not s.get("source_transition_ids") or set(s["source_transition_ids"]) - set(known)
        ]
        if len({known[t] for t in cited if t in known}) < 2:
            found.append("stages must rest on transitions of two source tasks")
    if stages and not _mentions(spec.get("final_sql", ""), names[-1]):
        found.append("final query must read the last stage")
    if any(_mentions(spec.get("alternate_sql", ""), n) for n in [*names, "sg_result"]):
        found.append("alternate query must not read stages")
    constraints = spec.get("constraints", [])
    if len(constraints) < 2:
        found.append("at least two constraints are required")
    found += [
        f"constraint must inspect sg_result: {c.get('description')}"
        for c in constraints
        if not _mentions(c.get("sql", ""), "sg_result") or not c.get("description")
    ]
    return found


def workflow(spark: SparkSession, spec: Mapping, max_rows: int = MAX_RESULT_ROWS) -> DataFrame:
    """Runs a staged workflow; one row per check: (check, name, passed, value).

    Each stage runs once: its rows are stored, and the next stage, its row count and its sample (the first
    ``SAMPLE_ROWS`` rows in the order of all columns, as JSON) read them. The result, stored up to one row
    beyond ``max_rows``, must have 1 to ``max_rows`` rows and the declared columns; every
    constraint one TRUE boolean; the alternate query the same rows, with ``order_by`` (columns of the
    result) in the same sequence.
    """
    broken = workflow_shape(spec)
    if broken:
        raise ValueError("; ".join(broken))

    def row(kind: str, name: str, df: DataFrame, passed: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("check"), F.lit(name).alias("name"),
            passed.alias("passed"), value.cast("string").alias("value"),
        )

    reports = []
    size = F.col("n")
    for stage in spec["stages"]:
        made = cut_lineage(spark.sql(stage["sql"]))
        made.createOrReplaceTempView(stage["name"])
        reports.append(row("stage", stage["name"], made.agg(F.count(F.lit(1)).alias("n")), size > 0, size))
        sample = stage_sample(made).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("rows"))
        reports.append(row("sample", stage["name"], sample, F.lit(True), F.to_json("rows", {"ignoreNullFields": "false"})))
    asked = spark.sql(spec["final_sql"])
    names = asked.columns
    if len(set(names)) != len(names):
        raise ValueError("result columns must have distinct names")
    # One row beyond the limit is enough to know that the result is too long.
    final = cut_lineage(asked.limit(max_rows + 1))
    final.createOrReplaceTempView("sg_result")
    counted = final.agg(F.count(F.lit(1)).alias("n"))
    reports.append(row("result", "row_count", counted, (size > 0) & (size <= max_rows), size))
    declared = list(spec.get("output_columns", []))
    reports.append(
        row("result", "columns", spark.range(1), F.lit(declared == names), F.lit(",".join(names)))
    )
    alternate = tolerant(spark.sql(spec["alternate_sql"]), final, order_by=spec.get("order_by", ()))
    reports.append(row("alternate", "agreement", alternate, F.col("matches"), F.col("reason")))
    for constraint in spec["constraints"]:
        made = spark.sql(constraint["sql"])
        fields = made.schema.fields
        boolean = len(fields) == 1 and isinstance(fields[0].dataType, T.BooleanType)
        value = F.col(f"`{fields[0].name}`") if boolean else F.lit(False)
        tested = made.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(value), F.lit(False)).alias("ok"))
        reports.append(
            row("constraint", constraint["description"], tested, F.lit(boolean) & (size == 1) & F.col("ok"), size)
        )
    whole = reports[0]
    for part in reports[1:]:
        whole = whole.unionByName(part)
    return whole


def stage_sample(made: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of a stage in the order of all columns that have one."""
    plain = [f.name for f in made.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return (made.orderBy(*[F.col(f"`{n}`") for n in plain]) if plain else made).limit(rows)


def gate(before: DataFrame, starter: DataFrame, oracle: DataFrame, reference: DataFrame) -> DataFrame:
    """Neither the pristine nor the starter result may match; the oracle must.

    One row: status, reason, and the three comparisons.
    """
    runs = None
    for order, (name, df) in enumerate((("before", before), ("starter", starter), ("oracle", oracle))):
        compared = multiset(df, reference).select(
            F.lit(order).alias("o"), F.lit(name).alias("run"), "matches"
        )
        runs = compared if runs is None else runs.unionByName(compared)
    of = lambda name: F.bool_or((F.col("run") == name) & F.col("matches"))
    flags = runs.agg(
        of("before").alias("before_matches"), of("starter").alias("starter_matches"), of("oracle").alias("oracle_matches")
    )
    reason = (
        F.when(F.col("before_matches"), "pristine data already solves the task")
        .when(F.col("starter_matches"), "starting project already solves the task")
        .when(~F.col("oracle_matches"), "oracle result does not equal the reference")
    )
    return flags.select(
        F.when(reason.isNull(), "validated").otherwise("rejected").alias("status"),
        reason.alias("reason"),
        "before_matches",
        "starter_matches",
        "oracle_matches",
    )
