"""Column expressions over text: pattern flags, bounded keywords, token sets.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters escaped before a keyword becomes a pattern.
_SPECIALS = re.compile(r"([.*+?^${}()|\[\]\\])")
_PLAIN = re.compile(r"[^.*+?^${}()|\[\]\\]+")
_BOUND, _END = "(^|[^a-z0-9])", "([^a-z0-9]|$)"


def keyword_pattern(keyword: str) -> str | None:
    """Bounded keyword pattern: the keyword must not touch a letter or digit
    on either side; inner blank runs match any blank run. Empty never matches.
    The pattern uses only syntax shared by Java and RE2."""
    escaped = _SPECIALS.sub(r"\\\1", keyword.strip().lower())
    escaped = re.sub(r"\s+", r"\\s+", escaped)
    if not escaped:
        return None
    return f"{_BOUND}{escaped}{_END}"


def flag(text: Column, pattern: str | None) -> Column:
    """Substring pattern test (no anchors added); NULL text is false.

    Plain alternatives are substring searches, many times faster than an
    alternation of a regular expression; a bounded keyword is looked for as
    a substring first and its bounds are tested only where it occurs."""
    if pattern is None:
        return F.lit(False)
    if pattern.startswith(_BOUND):
        word = pattern[len(_BOUND):].removesuffix(_END).split(r"\s+")[0]
        test = text.rlike(pattern)
        return F.coalesce(text.contains(word) & test if _PLAIN.fullmatch(word) else test, F.lit(False))
    parts = [pattern] if "(" in pattern else pattern.split("|")
    test, rest = None, "|".join(x for x in parts if not _PLAIN.fullmatch(x))
    for part in (x for x in parts if _PLAIN.fullmatch(x)):
        test = text.contains(part) if test is None else test | text.contains(part)
    if rest:
        test = text.rlike(rest) if test is None else test | text.rlike(rest)
    return F.coalesce(test, F.lit(False))


def token_set(text: Column) -> Column:
    """Distinct lower-case ``[a-z0-9]+`` tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def sql_str(value: str) -> str:
    """Quote a Python string as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"
