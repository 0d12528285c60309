"""Phrase hits in texts: a left-to-right sweep over one pattern of all phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from parlance.functions.batches import slices


class PhraseSweep:
    """Finds the hits of a set of phrases and the slices that they open, in one pass over a text.

    A hit counts where no earlier accepted hit covers its start; at one place the shortest phrase wins. A phrase never
    overlaps its own last hit, accepted or not.
    """

    def __init__(self, phrases: tuple[str, ...], stops: tuple[str, ...]):
        self.keys: dict[str, str] = {}  # lower-cased phrase to the phrase as given, the first in order of equal ones
        for phrase in sorted(p for p in phrases if p and p.strip()):
            self.keys.setdefault(phrase.lower().strip(), phrase)
        self.order = sorted(self.keys, key=len)
        alternatives = lambda words: "|".join(re.escape(w) for w in words)
        self.start = re.compile(f"(?=(?:{alternatives(self.order)}))") if self.order else None
        ends = sorted({s.lower().strip() for s in stops if s and s.strip()})
        self.stop = re.compile(f"(?=(?:{alternatives(ends)}))") if ends else None

    def hits(self, lowered: str) -> Iterator[tuple[int, int, str]]:
        if self.start is None:
            return
        free = dict.fromkeys(self.order, 0)
        border = 0
        for place in self.start.finditer(lowered):
            at = place.start()
            for key in self.order:
                if at >= free[key] and lowered.startswith(key, at):
                    free[key] = at + len(key)
                    if at >= border:
                        border = at + len(key)
                        yield at, border, self.keys[key]

    def slices(self, text: str) -> list[tuple[str, int, int, str]]:
        """``phrase, start, end, transcript``: a slice ends at the next hit, at a stop phrase or with the text."""
        lowered, out = text.lower(), []
        open_hit: tuple[int, int, str] | None = None
        for hit in [*self.hits(lowered), None]:
            if open_hit is not None:
                begin, end, phrase = open_hit
                until = len(text) if hit is None else hit[0]
                stop = self.stop.search(lowered, end) if self.stop else None
                if stop is not None:
                    until = min(until, stop.start())
                out.append((phrase, begin, end, text[begin:until].strip()))
            open_hit = hit
        return out


@lru_cache(maxsize=256)
def sweep(phrases: tuple[str, ...], stops: tuple[str, ...]) -> PhraseSweep:
    return PhraseSweep(phrases, stops)


ARROW_MATCHES = pa.list_(
    pa.struct(
        [("action", pa.int32()), ("nth", pa.int32()), ("phrase", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("transcript", pa.string())]
    )
)
MATCH = "action int, nth int, phrase string, start int, end int, transcript string"


def mentions_any(text: Column, phrases: Column) -> Column:
    """Whether a text holds one of the phrases at all, whatever their case."""
    lowered = F.lower(text)
    named = F.filter(phrases, lambda p: p.isNotNull() & (F.length(F.trim(p)) > 0))
    # letters whose lower case depends on the runtime never rule a text out
    return F.exists(named, lambda p: F.contains(lowered, F.lower(F.trim(p)))) | text.rlike("[^\\x00-\\x7F]")


def phrase_matches(text: Column, phrases: Column, stops: Column) -> Column:
    """Matches of several lists in one text: an array of ``action, nth, phrase, start, end, transcript``.

    ``phrases`` and ``stops`` are arrays of lists, one of each per action; ``action`` is the place of the list. Texts without
    any phrase stay in the JVM.
    """

    @F.arrow_udf(ArrayType(StructType.fromDDL(MATCH)))
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, wanted, ended in batches:
            for parts in zip(slices(texts), slices(wanted), slices(ended)):
                yield pa.array([matches(*row) for row in zip(*(p.to_pylist() for p in parts))], ARROW_MATCHES)

    def matches(text: str | None, lists: list | None, stop_lists: list | None) -> list[dict]:
        rows = []
        if text is not None and lists is not None:
            for action, (words, ends) in enumerate(zip(lists, stop_lists)):
                hits = sweep(tuple(words if words is not None else ()), tuple(ends if ends is not None else ())).slices(text)
                rows += [{"action": action, "nth": n, "phrase": p, "start": a, "end": b, "transcript": t} for n, (p, a, b, t) in enumerate(hits)]
        return rows

    return found(F.when(mentions_any(text, F.flatten(phrases)), text), phrases, stops)


class PhraseHits:
    """Table function ``(text, phrases, stop_phrases) -> nth, phrase, start, end, transcript``: a row per match.

    A null text or list of phrases gives no rows; a null list of stop phrases is an empty one. Arguments of other types
    are refused when a query is analysed, before it runs.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, phrases: AnalyzeArgument, stop_phrases: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError(f"phrase_hits: text must be a string, not {text.dataType.simpleString()}")
        for name, argument in (("phrases", phrases), ("stop_phrases", stop_phrases)):
            kind = argument.dataType
            if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType)):
                raise ValueError(f"phrase_hits: {name} must be an array of strings, not {kind.simpleString()}")
        kinds = {"nth": IntegerType(), "phrase": StringType(), "start": IntegerType(), "end": IntegerType(), "transcript": StringType()}
        return AnalyzeResult(StructType([StructField(name, kind) for name, kind in kinds.items()]))

    def eval(self, text, phrases, stop_phrases):
        if text is None or phrases is None:
            return
        for nth, (phrase, start, end, transcript) in enumerate(sweep(tuple(phrases), tuple(stop_phrases or ())).slices(text)):
            yield nth, phrase, start, end, transcript


def register_phrase_hits(spark: SparkSession, name: str = "phrase_hits") -> None:
    """Make ``PhraseHits`` known to SQL: ``FROM texts t, LATERAL phrase_hits(t.text, t.phrases, t.stop_phrases)``.

    The column form ``phrase_matches`` does the same in Arrow batches, and many lists in one call.
    """
    spark.udtf.register(name, F.udtf(PhraseHits))
