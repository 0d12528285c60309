"""Column expressions over text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def string_or_null(text: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(strip(text), F.lit(""))


def cap(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has no built-in for it. Only texts that are not plain ASCII reach Python."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.when(other.isNull(), text).otherwise(_compose(other))


def tokens(text: Column) -> Column:
    """Words for scoring: composed, lower case, repeat markers and punctuation dropped."""
    lowered = F.lower(nfkc(F.coalesce(text, F.lit(""))))
    unmarked = F.regexp_replace(lowered, r"\(×\d+\)", " ")
    spaced = F.regexp_replace(unmarked, r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def phrase_list(raw: Column) -> Column:
    """A phrase field split at line breaks and commas; blanks dropped."""
    return F.filter(F.transform(F.split(raw, r"[\r\n,]"), strip), lambda p: p != "")


def shell_quoted(value: Column) -> Column:
    """The value as one shell word."""
    safe = value.rlike(r"^[a-zA-Z0-9_@%+=:,./-]+$")
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(safe, value).otherwise(quoted)


def without_thinking(text: Column) -> Column:
    """The answer after the last closed reasoning block; before an unclosed one."""
    after = F.element_at(F.split(text, "</think>", -1), -1)
    before = F.element_at(F.split(text, "<think>", -1), 1)
    return F.when(text.contains("</think>"), after).otherwise(before)


def without_fences(text: Column) -> Column:
    """The content of a fenced block, if the text starts with a fence and has a second line."""
    body = strip(text)
    fenced = body.startswith("```") & body.contains("\n")
    opened = F.regexp_replace(body, r"^[^\n]*\n", "")
    return F.when(fenced, strip(F.regexp_replace(opened, r"```\s*$", ""))).otherwise(body)


def lines_of(text: Column) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda line: line != "")


def fingerprint(snapshot: Column) -> Column:
    """Sixteen hex digits of a settings map, whatever the order of its keys."""
    entries = F.array_sort(F.map_entries(snapshot))
    return F.substring(F.sha2(F.to_json(F.map_from_entries(entries)), 256), 1, 16)
