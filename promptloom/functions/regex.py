"""Helpers to write regexes once and get the same matches from Spark's Java engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Unicode text calls white space; used for cheap end-trimming without a regex.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line ends other than a line feed.
OTHER_LINE_ENDS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]

_UNICODE_CLASS = re.compile(r"\\[wWsSdDbB]|\(\?i")


def java(pattern: str, flags: str = "") -> str:
    """Prefix Java flags: ``d`` (only ``\\n`` ends a line) and ``U`` where Unicode matters."""
    unicode = "U" if "i" in flags or _UNICODE_CLASS.search(pattern) else ""
    return f"(?d{unicode}{flags}){pattern}"


def sub(col: Column, pattern: str, replacement: str = "", flags: str = "") -> Column:
    """Replace every match. Group references are written ``\\1`` as in the rule lists."""
    java_replacement = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    return F.regexp_replace(col, F.lit(java(pattern, flags)), F.lit(java_replacement))


def found(col: Column, pattern: str, flags: str = "") -> Column:
    return col.rlike(java(pattern, flags))


def find_all(col: Column, pattern: str, flags: str = "") -> Column:
    """All matches, whole match text, left to right."""
    return F.regexp_extract_all(col, F.lit(java(pattern, flags)), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def text_array(values: list[str]) -> Column:
    """A constant array column, parsed in one call."""
    return F.expr(f"array({', '.join(sql_text(v) for v in values)})")


def contains_any(col: Column, words: list[str]) -> Column:
    """Byte-level substring tests: far cheaper than a regex, so they guard the regexes."""
    return any_of([col.contains(word) for word in words])


def contains_one_of(col: Column, words: list[str]) -> Column:
    """As :func:`contains_any`, over a constant array: for long lists and inside lambdas."""
    return F.exists(text_array(words), lambda word: F.contains(col, word))


def let(col: Column, body) -> Column:
    """Evaluate ``col`` once and hand it to ``body``; keeps nested expressions linear in size."""
    return F.transform(F.array(col), body)[0]
