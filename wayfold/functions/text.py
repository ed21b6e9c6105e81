"""Text and identity functions; every one is a plain Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Excerpt markers and window sizes of the published protocol.
EXCERPT_MARKER = "\n[EXCERPT OMISSION]\n"
WINDOW_MARKER = "\n[OLDER PREFIX CONTENT OMITTED]\n"
WINDOW_LIMIT, WINDOW_HEAD, WINDOW_TAIL = 48_000, 6_000, 42_000
# Words that carry no meaning in relation retrieval.
STOP_TERMS = (
    "select", "from", "where", "group", "order", "table", "schema", "source",
    "history", "transition", "task", "stage", "selecting", "main", "raw", "data",
)
# Patterns.
TOKEN_PATTERN = r"[a-z]{4,}"
TERM_PATTERN = r"[a-zA-Z][a-zA-Z0-9]*"
# White space as in the published normalisation: ASCII, separators and wide blanks.
SPACE_PATTERN = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# The word borders are written out, so that letters of any language count alike in every regex engine.
RELATION_PATTERN = r"(?:^|[^\p{L}\p{M}\p{N}_])(?:from|join)[ \t\n\x0b\f\r]+([a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)?)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fingerprint(value: Column | str) -> Column:
    """SHA-256 of compact JSON. Struct fields must be in the wanted key order."""
    return F.sha2(F.to_json(_col(value), {"ignoreNullFields": "false"}), 256)


def fingerprint_strings(*parts: Column | str) -> Column:
    """SHA-256 of a JSON list of strings, for identifiers (JSON-escaped by Spark)."""
    return F.sha2(F.to_json(F.array(*[_col(p) for p in parts])), 256)


def squeeze(text: Column | str) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(_col(text), SPACE_PATTERN, " "))


def epoch(value: Column | str) -> Column:
    """Seconds since 1970 from a number or an ISO timestamp, else NULL."""
    raw = _col(value).cast("string")
    number = F.when(raw.rlike(r"^\s*[-+]?[0-9.]+([eE][-+]?[0-9]+)?\s*$"), raw.try_cast("double"))
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw.try_cast("timestamp"))
    return F.coalesce(number, F.unix_micros(iso) / F.lit(1e6))


def clipped(text: Column | str, budget: int) -> Column:
    return F.length(_col(text)) > budget


def excerpt(text: Column | str, budget: int) -> Column:
    """Text within the budget unchanged; otherwise first half, marker, last half."""
    value, half = _col(text), budget // 2
    return F.when(
        clipped(value, budget),
        F.concat(F.substring(value, 1, half), F.lit(EXCERPT_MARKER), F.right(value, F.lit(half))),
    ).otherwise(value)


def visible_window(text: Column | str) -> Column:
    """Head and tail of an over-long prefix; the tail holds the current state."""
    value = _col(text)
    return F.when(
        clipped(value, WINDOW_LIMIT),
        F.concat(
            F.substring(value, 1, WINDOW_HEAD),
            F.lit(WINDOW_MARKER),
            F.right(value, F.lit(WINDOW_TAIL)),
        ),
    ).otherwise(value)


def bounded_evidence(text: Column | str, budget: int) -> Column:
    """Struct(data, clipped, original_length, original_sha256, note)."""
    value = _col(text)
    over = clipped(value, budget)
    return F.struct(
        F.substring(value, 1, budget).alias("data"),
        over.alias("clipped"),
        F.length(value).cast("long").alias("original_length"),
        F.sha2(value, 256).alias("original_sha256"),
        F.when(over, F.lit("incomplete evidence")).alias("note"),
    )


def token_set(text: Column | str) -> Column:
    """Distinct lower-case words of at least four ASCII letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), F.lit(0)))


def term_set(text: Column | str) -> Column:
    """Words longer than two characters, stop words dropped, trailing s stripped."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(TERM_PATTERN), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_TERMS))
    return F.array_distinct(F.transform(kept, lambda w: F.rtrim(w, F.lit("s"))))


def unquoted_lower(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(text), r'["`]', ""))


def relation_refs(text: Column | str) -> Column:
    """Distinct relation names that follow FROM or JOIN, quotes removed."""
    return F.array_distinct(
        F.regexp_extract_all(unquoted_lower(text), F.lit(RELATION_PATTERN), F.lit(1))
    )


def row_number_word(value: Column | str, digits: int = 15) -> Column:
    """First hex digits of a SHA-256 as a non-negative number (exact up to 15)."""
    return F.conv(F.substring(F.sha2(_col(value), 256), 1, digits), 16, 10).cast("long")


def seeded_rank_key(seed: int, *parts: Column | str) -> Column:
    """Reproducible pseudo-random order key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))
