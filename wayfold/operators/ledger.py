"""Literal evidence of a prefix: quoted text only, nothing inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import clipped, excerpt, squeeze
from wayfold.sources.logs import PARSE_ERROR_TEXT

# Markers, patterns, snippet margins and budgets of the protocol.
TASK_MARKER = "Task Description:"
TERMINAL_MARKER = "Current terminal state:"
ALIAS_PATTERN = r"(?iU)\b[A-Za-z_][\w.]*\s+AS\s+[A-Za-z_][\w]*"
SCHEMA_PATTERN = r"(?iU)\bschema\s*[:=]\s*[^\n,}]+|\b(?:main|daily_analytics)\.[A-Za-z_]\w*"
MARGIN_BEFORE, MARGIN_AFTER = 60, 120
MAX_LINES, MAX_CHARACTERS = 10, 9_000
REQUIREMENT_BUDGET, OBSERVATION_BUDGET = 2_000, 1_200
# Fixed value: characters of an empty ledger's JSON with its two notes on selection and interpretation.
ENVELOPE = 404
TOOL_ROLES = ("user", "tool")
MARK = "\ue000"


def requirement(messages: DataFrame) -> DataFrame:
    """Task text of the first message that holds one, per history."""
    found = messages.filter(F.col("content").contains(TASK_MARKER)).select(
        "history_id", "message_index", _after_marker(F.col("content")).alias("_t")
    )
    first = found.groupBy("history_id").agg(
        F.min("message_index").alias("message_index"), F.min_by("_t", "message_index").alias("_t")
    )
    return first.select(
        "history_id",
        "message_index",
        F.lit("task_requirement").alias("source_kind"),
        excerpt("_t", REQUIREMENT_BUDGET).alias("text"),
        clipped("_t", REQUIREMENT_BUDGET).alias("clipped"),
    )


def _after_marker(content: Column) -> Column:
    """Text between the task marker and the terminal marker, trimmed."""
    tail = F.regexp_replace(content, r"(?s)^.*?\Q" + TASK_MARKER + r"\E", "")
    head = F.regexp_replace(tail, r"(?s)\Q" + TERMINAL_MARKER + r"\E.*$", "")
    return F.regexp_replace(head, r"^\s+|\s+$", "")


def recent_observations(messages: DataFrame, last: int = 2) -> DataFrame:
    """Last tool or user messages of every history, as excerpts."""
    seen = messages.filter((F.col("message_index") > 0) & F.col("role").isin(*TOOL_ROLES))
    latest = Window.partitionBy("history_id").orderBy(F.col("message_index").desc())
    kept = seen.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= last)
    return kept.select(
        "history_id",
        "message_index",
        F.when(F.col("content").contains(PARSE_ERROR_TEXT), "parser_feedback")
        .otherwise("terminal_transcript")
        .alias("source_kind"),
        excerpt("content", OBSERVATION_BUDGET).alias("text"),
        clipped("content", OBSERVATION_BUDGET).alias("clipped"),
    )


def _hits(content: Column, pattern: str, name: str) -> Column:
    """All matches with their 1-based start.

    A mark is put before every match; the pieces between marks give the places.
    """
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    pieces = F.split(F.regexp_replace(content, pattern, MARK + "$0"), MARK)
    start = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at")),
        lambda acc, piece: F.struct(
            (acc["next"] + F.length(piece)).alias("next"),
            F.concat(acc["at"], F.array(acc["next"] + F.length(piece))).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    return F.transform(
        F.arrays_zip(found.alias("matched_text"), start.alias("start")),
        lambda z: F.struct(
            F.lit(name).alias("pattern"), z["matched_text"].alias("matched_text"), z["start"].alias("start")
        ),
    )


def mapping_lines(messages: DataFrame, top: int = MAX_LINES) -> DataFrame:
    """Explicit SQL aliases and schema names, at most ``top`` per history.

    Repeats within a kind of source count once: tool text is preferred, then the
    latest message, then the order of the patterns and of the text.
    """
    tool = F.col("role").isin(*TOOL_ROLES)
    kind = (
        F.when(F.col("message_index") == 0, "task_requirement")
        .when(tool, "terminal_transcript")
        .otherwise("learner_command_or_assertion")
    )
    content = F.replace(F.coalesce("content", F.lit("")), F.lit(MARK), F.lit(""))
    listed = messages.select(
        "history_id",
        "message_index",
        (~F.coalesce(tool, F.lit(False))).alias("_not_tool"),
        kind.alias("source_kind"),
        content.alias("_content"),
        F.posexplode(
            F.concat(
                _hits(content, ALIAS_PATTERN, "explicit_sql_alias"),
                _hits(content, SCHEMA_PATTERN, "schema_or_qualified_name"),
            )
        ).alias("_place", "_hit"),
    )
    start0 = F.col("_hit.start") - 1
    end0 = start0 + F.length("_hit.matched_text")
    low = F.greatest(F.lit(0), start0 - MARGIN_BEFORE)
    high = F.least(F.length("_content"), end0 + MARGIN_AFTER)
    rows = listed.select(
        "history_id", "message_index", "source_kind", "_not_tool", "_place",
        F.col("_hit.pattern").alias("pattern"),
        F.col("_hit.matched_text").alias("matched_text"),
        F.lower(squeeze("_hit.matched_text")).alias("_identity"),
        F.substring(F.col("_content"), low + 1, high - low).alias("text"),
        ((low > 0) | (high < F.length("_content"))).alias("clipped"),
    )
    preferred = F.struct("_not_tool", (-F.col("message_index")).alias("_i"), "_place")
    rest = ["message_index", "pattern", "matched_text", "text", "clipped", "_not_tool", "_place"]
    unique = rows.groupBy("history_id", "source_kind", "_identity").agg(
        F.min_by(F.struct(*rest), preferred).alias("_r")
    ).select("history_id", "source_kind", "_r.*")
    # The rank is a stable sort: ties keep the order in which the lines were met.
    rank = Window.partitionBy("history_id").orderBy(
        F.col("source_kind") != "terminal_transcript",
        F.col("pattern") != "explicit_sql_alias",
        F.col("message_index").desc(),
        "_not_tool",
        "_place",
    )
    kept = unique.withColumn("line", F.row_number().over(rank)).filter(F.col("line") <= top)
    return kept.drop("_not_tool", "_place")


def json_length(text: Column) -> Column:
    """Characters of a text as a JSON string: two quotes, two for an escaped sign, six for other control characters."""
    short = F.length(F.regexp_replace(text, r'[^"\\\n\r\t\x08\f]', ""))
    control = F.length(F.regexp_replace(text, r"[^\x00-\x07\x0b\x0e-\x1f]", ""))
    return F.length(text) + short + 5 * control + 2


def entry_length(*texts: str) -> Column:
    """Characters of a ledger entry's JSON: keys, index, the given texts and the flag."""
    names = ["message_index", *texts, "clipped"]
    keys = sum(len(f'"{n}": ') for n in names) + 2 * (len(names) - 1) + 2
    flag = F.when(F.col("clipped"), 4).otherwise(5)
    return sum((json_length(F.col(t)) for t in texts), F.lit(keys) + F.length(F.col("message_index").cast("string")) + flag)


def ledger(messages: DataFrame, top: int = MAX_LINES, budget: int = MAX_CHARACTERS) -> DataFrame:
    """Requirement, recent observations and mapping lines within a size budget.

    Mapping lines are dropped from the end while the ledger's JSON, with all keys and notes, is longer
    than ``budget`` characters.
    """
    shape = ["history_id", "section", "line", "message_index", "source_kind", "pattern", "text", "clipped", "_size"]
    none = F.lit(None).cast("string")
    short = entry_length("source_kind", "text")
    need = requirement(messages).select(
        "history_id", F.lit(0).alias("section"), F.lit(1).alias("line"), "message_index",
        "source_kind", none.alias("pattern"), "text", "clipped", short.alias("_size"),
    )
    recent = recent_observations(messages).select(
        "history_id", F.lit(1).alias("section"),
        F.col("message_index").cast("int").alias("line"), "message_index",
        "source_kind", none.alias("pattern"), "text", "clipped", short.alias("_size"),
    )
    lines = mapping_lines(messages, top).withColumn("section", F.lit(2)).withColumn(
        "_size", entry_length("source_kind", "pattern", "matched_text", "text")
    ).select(*shape)
    whole = need.unionByName(recent).unionByName(lines)
    of_history = Window.partitionBy("history_id")
    running = of_history.orderBy("section", "line").rowsBetween(Window.unboundedPreceding, 0)
    # Entries of a list are two characters apart; without a requirement its place holds "null".
    first = F.row_number().over(Window.partitionBy("history_id", "section").orderBy("line")) == 1
    gap = F.when((F.col("section") > 0) & ~F.col("_first"), 2).otherwise(0)
    sized = whole.withColumn("_first", first).withColumn("_so_far", F.sum(F.col("_size") + gap).over(running)).withColumn(
        "_none", F.when(F.min("section").over(of_history) > 0, 4).otherwise(0)
    )
    fits = F.col("_so_far") + F.col("_none") + ENVELOPE <= budget
    return sized.filter((F.col("section") < 2) | fits).drop("_size", "_first", "_so_far", "_none")
