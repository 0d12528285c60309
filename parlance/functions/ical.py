"""Column expressions for calendar text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_OCTETS = 75  # fixed value: longest line of the format


def utc_stamp(value: Column) -> Column:
    return F.date_format(value, "yyyyMMdd'T'HHmmss'Z'")


def escaped(text: Column) -> Column:
    """Text value: backslash, semicolon, comma and line breaks escaped; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, coded in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\n"), ("\r", "\n"), ("\n", "\\n")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def _fold_one(line: str) -> str:
    raw = line.encode("utf-8")
    parts, begin, room = [], 0, MAX_OCTETS
    while len(raw) - begin > room:
        end = begin + room
        while raw[end] & 0xC0 == 0x80:  # stay on a character border
            end -= 1
        parts.append(raw[begin:end])
        begin, room = end, MAX_OCTETS - 1  # continuation lines begin with a blank
    parts.append(raw[begin:])
    return "\r\n ".join(p.decode("utf-8") for p in parts)


@F.pandas_udf(StringType())
def _fold(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else _fold_one(x))


def folded(line: Column) -> Column:
    """Lines over 75 octets continued after a line break and a blank; short ones stay in the JVM."""
    long = F.octet_length(line) > MAX_OCTETS
    return F.when(long, _fold(F.when(long, line))).otherwise(line)
