"""JSON values in free text: whole, inside a code fence, or behind other words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: start of a code fence.
FENCE = "```"
STRING = r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"'
ATOM = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity"
TOKEN = re.compile(rf"[ \t\n\r]*(?:([\[{{])|([\]}}])|([,:])|({STRING})|({ATOM}))")
OPENING = re.compile(r"[\[{]")
# What may come next inside a container.
VALUE, VALUE_OR_END, KEY, KEY_OR_END, COLON, COMMA_OR_END = range(6)


def unfenced(text: Column) -> Column:
    """Text inside a code fence: first line and closing fence dropped."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_replace(trimmed, r"^[^\n]*\n", "")
    inner = F.regexp_replace(body, r"(?s)```(?!.*```).*$", "")
    return F.when(trimmed.startswith(FENCE), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(trimmed)


def _read(text: str, start: int) -> tuple[int | None, list[int], list[tuple[int, int]]]:
    """(end or None, containers still open, complete inner ones) of a container that starts at ``start``."""
    opened: list[int] = []
    closed: list[tuple[int, int]] = []
    expect: list[int] = []
    at = start
    while True:
        token = TOKEN.match(text, at)
        if token is None:
            return None, opened, closed
        here = expect[-1] if expect else VALUE
        bracket, end, sign, string, atom = token.groups()
        if bracket:
            if here not in (VALUE, VALUE_OR_END):
                return None, opened, closed
            opened.append(token.start(1))
            expect.append(VALUE_OR_END if bracket == "[" else KEY_OR_END)
        elif end:
            kind = text[opened[-1]]
            fits = end == ("]" if kind == "[" else "}")
            if not fits or here not in (VALUE_OR_END, KEY_OR_END, COMMA_OR_END):
                return None, opened, closed
            begin = opened.pop()
            expect.pop()
            if not opened:
                return token.end(), opened, closed
            closed.append((begin, token.end()))
            expect[-1] = COMMA_OR_END
        elif sign == ",":
            if here != COMMA_OR_END:
                return None, opened, closed
            expect[-1] = VALUE if text[opened[-1]] == "[" else KEY
        elif sign == ":":
            if here != COLON:
                return None, opened, closed
            expect[-1] = VALUE
        elif string and here in (KEY, KEY_OR_END):
            expect[-1] = COLON
        elif here in (VALUE, VALUE_OR_END):
            expect[-1] = COMMA_OR_END
        else:
            return None, opened, closed
        at = token.end()


def first_value(text: str | None) -> str | None:
    """The first list or object of a text that is complete JSON, from the first place where one starts.

    A reading that fails has decided all brackets outside its strings: the inner containers it closed are
    values, those still open are none. Only brackets inside its strings are read anew. A reading
    that starts inside another's string sees strings where the other sees none, to the end, so no place
    belongs to more than two readings, and the time is linear in the length.
    """
    if not text:
        return None
    failed: set[int] = set()
    whole: dict[int, int] = {}
    for found in OPENING.finditer(text):
        start = found.start()
        if start in whole:
            return text[start : whole[start]]
        if start in failed:
            continue
        end, opened, closed = _read(text, start)
        if end is not None:
            return text[start:end]
        failed.update(opened)
        whole.update(closed)
    return None


def first_values(texts: Column) -> Column:
    """``first_value`` of a column; null stays null."""

    def scan(values: pd.Series) -> pd.Series:
        return values.map(first_value)

    return F.pandas_udf(scan, "string")(texts)


def first_values_of_lists(lists: Column) -> Column:
    """``first_value`` of each text of a column of lists."""

    def scan(values: pd.Series) -> pd.Series:
        return values.map(lambda texts: None if texts is None else [first_value(t) for t in texts])

    return F.pandas_udf(scan, "array<string>")(lists)


def parsed(text: Column) -> Column:
    """The text without its fence as a variant, null where it is no JSON as a whole."""
    return F.try_parse_json(unfenced(text))


def compact(span: Column) -> Column:
    """A value's JSON text without blanks; as found where Spark doesn't parse it (NaN, Infinity)."""
    return F.coalesce(F.to_json(F.try_parse_json(span)), span)
