"""Finding and mending the JSON object in a model's answer."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.functions.batches import slices
from parlance.functions.text import string_or_null, without_fences, without_thinking

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{}\[\],]', re.DOTALL)
_CLOSE = {"{": "}", "[": "]"}
_PIECE = re.compile(r'(?P<space>\s+)|(?P<text>"(?:[^"\\]|\\.)*(?P<quote>"?))|(?P<mark>[{}\[\],:])|(?P<bare>[^\s{}\[\],:"]+)', re.DOTALL)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|u[0-9a-fA-F]{0,3}\Z|\Z|.)|[\x00-\x1f]", re.DOTALL)
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_LITERALS = {"true": "true", "false": "false", "null": "null", "none": "null", "nan": "null"}


def first_object(text: str) -> str:
    """The first balanced ``{…}``; from the first brace to the end if it never closes."""
    begin = text.find("{")
    if begin < 0:
        return text
    depth = 0
    for token in _TOKEN.finditer(text, begin):
        depth += {"{": 1, "}": -1}.get(token.group(), 0)
        if depth == 0:
            return text[begin : token.end()]
    return text[begin:]


def _string(found: re.Match) -> str:
    """A string as JSON takes it: control characters and false escapes written out, an escape that the text's end cuts left out."""
    closed = bool(found["quote"])

    def written(part: re.Match) -> str:
        after = part[1]
        if after is None:
            return f"\\u{ord(part[0]):04x}"
        if part.end() == len(part.string) and not closed and (not after or (after[0] == "u" and len(after) < 5)):
            return ""
        if after and (after in '"\\/bfnrt' or len(after) == 5):
            return part[0]
        return after if after == "'" else "\\" + _ESCAPE.sub(written, part[0]) if after in "\n\r\t" else "\\" + part[0]

    body = found["text"][1 : len(found["text"]) - closed]
    return '"' + _ESCAPE.sub(written, body) + ('"' if closed else "")


def patched(text: str) -> str | None:
    """An object with its faults mended where they are, and all that stands around them kept; the end may be open.

    Missing and surplus commas, bare keys, broken literals and missing values (null), false escapes, raw control characters
    and missing inner brackets are mended. None where anything else is wrong: quotes of another kind, words beside a string, ...
    """
    out: list[str] = []
    stack: list[str] = []
    state = "value"  # what may come: value, key, colon, or after (a comma or a bracket)
    bare = comma = False  # the last value was no string, number or bracket; a comma waits to be written
    for found in _PIECE.finditer(text):
        mark, last = found[0], found.end() == len(text)
        if found["space"]:
            continue
        if state == "end":
            return None
        inside = stack[-1] if stack else ""
        if found["mark"] and mark in "}]":
            opener = "{" if mark == "}" else "["
            if opener not in stack or state == "colon":
                return None
            if state == "value" and inside == "{":
                out.append("null")
            comma = False
            while True:
                top = stack.pop()
                out.append(_CLOSE[top])
                if top == opener:
                    break
            state, bare = ("after" if stack else "end"), False
        elif mark == ",":
            if state == "colon":
                return None
            if state == "value" and inside == "{":
                out.append("null")
                state = "after"
            if state == "after":
                comma, state, bare = True, "key" if inside == "{" else "value", False
        elif mark == ":":
            if state != "colon":
                return None
            out.append(":")
            state = "value"
        else:
            word = bool(found["bare"])
            if state == "after":  # a missing comma
                if bare or (word and inside == "[" and not _NUMBER.fullmatch(mark)):
                    return None
                comma, state = True, "key" if inside == "{" else "value"
            if comma:
                out.append(",")
                comma = False
            if state == "colon":
                return None
            if state == "key":
                if not found["text"] and not (word and (last or re.fullmatch(r"[^\W\d][\w-]*", mark))):
                    return None
                out.append(_string(found) if found["text"] else mark if last else f'"{mark}"')
                state = "colon"
            elif mark in _CLOSE:
                stack.append(mark)
                out.append(mark)
                state, bare = "key" if mark == "{" else "value", False
            elif not stack:
                return None
            elif found["text"]:
                out.append(_string(found))
                state, bare = "after", False
            else:
                whole = _NUMBER.fullmatch(mark) is not None
                if "'" in mark or "`" in mark:
                    return None
                out.append(mark if whole or last else _LITERALS.get(mark.lower(), "null"))
                state, bare = "after", not whole
    return "".join(out)


#: Quotes that may open a text, each with those that may close it.
_QUOTES = {'"': '"\u201d', "'": "'\u2019", "`": "`'", "\u201c": '\u201d\u201c"', "\u201d": '\u201d"', "\u201e": '\u201c\u201d"', "\u2018": "\u2019'", "\u2019": "\u2019'"}
_OPEN = "".join(_QUOTES)
_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.DOTALL)
_KEY = re.compile(rf"(?:[{_OPEN}][^\n{{}}\[\]:,{_OPEN}]{{0,120}}[{_OPEN}]|[^\W\d][\w-]*)\s*:|[{_OPEN}][^:{{}}\[\]]*\Z|[^\W\d]\w*\Z", re.DOTALL)
_ITEM = re.compile(rf"[{_OPEN}{{\[\-\d.]|(?:true|false|null|none|nan)\b", re.IGNORECASE)
_POINT = re.compile(r"([+-]?)(\d*)\.?(\d*)([eE][+-]?\d+)?")


def _goes_on(text: str, at: int, place: str) -> bool:
    """Whether the object makes sense from here on, right behind a text at ``place`` (key, member or item)."""
    at = _SKIP.match(text, at).end()
    mark = text[at : at + 1]
    if not mark:
        return True
    if place == "key":
        return mark == ":"
    after = _KEY if place == "member" else _ITEM
    if mark == ",":
        then = _SKIP.match(text, at + 1).end()
        return then == len(text) or text[then] in ",}]" or after.match(text, then) is not None
    return mark in "}]"


def _quoted(text: str, at: int, place: str) -> tuple[str, int, bool]:
    """A quoted text from its opening quote: its content, where it ends, and whether it was closed.

    Of the quotes that may close it, the first counts behind which the object goes on; where there is none, the first that a
    further member follows without a comma, then the first at all. The quotes before it belong to the text.
    """
    closers, second, first = _QUOTES[text[at]], None, None
    k = at + 1
    while k < len(text):
        if text[k] == "\\":
            k += 2
            continue
        if text[k] in closers:
            if _goes_on(text, k + 1, place):
                return text[at + 1 : k], k + 1, True
            if second is None and place != "key":
                then = _SKIP.match(text, k + 1).end()
                missed = _KEY.match(text, then) if place == "member" else then > k + 1 and text[then] in _OPEN + "{["
                second = k if missed and (place == "item" or text[then] in _OPEN) else None
                if second is not None:
                    return text[at + 1 : second], second + 1, True
            first = k if first is None else first
        k += 1
    if first is None:
        return text[at + 1 :], len(text), False
    return text[at + 1 : first], first + 1, True


def _written_text(content: str, closed: bool) -> str:
    """A text between double quotes: those inside it are escaped, escaped single quotes are plain."""
    inside = re.sub(r"\\(.)|\"", lambda m: '\\"' if m[0] == '"' else m[1] if m[1] in "'`" else m[0], content, flags=re.DOTALL)
    return '"' + inside + ('"' if closed else "")


def _bare(word: str) -> str:
    """A value without quotes: numbers as JSON writes them, broken literals as they are (they become null), anything else a text."""
    found = _POINT.fullmatch(word)
    if found and (found[2] or found[3]):
        digits = found[2].lstrip("0") or "0"
        return ("-" if found[1] == "-" else "") + digits + (f".{found[3]}" if found[3] else "") + (found[4] or "")
    low = word.lower()
    if any(known.startswith(low) for known in (*_LITERALS, "undefined", "infinity", "-infinity", "+infinity")):
        return word
    return json.dumps(word, ensure_ascii=False)


def requoted(text: str) -> str:
    """The first object of a text with quotes of one kind, without comments, its bare texts quoted; its structure is left as it is.

    Single, typographic and back quotes open and close texts, quotes inside a text are told from its end by what follows, words
    without quotes are read up to the next member or item, numbers such as ``.5`` and ``+1`` are written out.
    """
    begin = text.find("{")
    if begin < 0:
        return text
    out: list[str] = []
    stack: list[str] = []
    at, place = begin, "key"  # where the next text would stand
    while at < len(text):
        skipped = _SKIP.match(text, at).end()
        if skipped > at:
            out.append(" ")
            at = skipped
            continue
        mark = text[at]
        at += 1
        if mark in "{[":
            stack.append(mark)
            out.append(mark)
            place = "key" if mark == "{" else "item"
        elif mark in "}]":
            out.append(mark)
            opener = "{" if mark == "}" else "["
            while stack and stack[-1] != opener and opener in stack:
                stack.pop()
            if stack:
                stack.pop()
            if not stack:
                break
            place = "member-end" if stack[-1] == "{" else "item"
        elif mark == ",":
            out.append(mark)
            place = "key" if stack[-1] == "{" else "item"
        elif mark == ":":
            out.append(mark)
            place = "member"
        elif mark in _QUOTES:
            if place == "member-end":  # a comma is missing
                place = "key"
            content, at, closed = _quoted(text, at - 1, place)
            out.append(_written_text(content, closed))
            place = "member-end" if place == "member" else place
        else:
            if place == "member-end":
                place = "key"
            start, at = at - 1, _bare_end(text, at - 1, place)
            word = text[start:at].rstrip()
            out.append(word if place == "key" else _bare(word) if at < len(text) else word)
            place = "member-end" if place == "member" else place
    return "".join(out)


def _bare_end(text: str, at: int, place: str) -> int:
    """Where a word without quotes ends: a key at its colon, a number at the next sign, another value where the object goes on."""
    start, at = at, at + 1
    while at < len(text):
        mark = text[at]
        if place == "key":
            if mark in ":,{}[]" or mark.isspace():
                break
        elif mark in "}]" or (mark == "," and (_goes_on(text, at, place) or _POINT.fullmatch(text[start:at].rstrip()))) or (mark == "/" and text[at : at + 2] in ("//", "/*") and text[at - 1].isspace()):
            break
        elif mark.isspace():
            then = _SKIP.match(text, at).end()
            if text[then : then + 1] in _OPEN and then < len(text) and (place == "item" or _KEY.match(text, then)):
                break
            if place == "item" and _POINT.fullmatch(text[start:at]) and _ITEM.match(text, then):
                break
        at += 1
    return at


def mended(text: str) -> str | None:
    """A damaged object closed at the last place that makes sense; what follows it is dropped.

    None if that fails or leaves no member.
    """
    stack: list[str] = []
    cuts: list[tuple[int, tuple[str, ...]]] = []  # where the text may end, and what is open there
    tail = ""
    for token in _TOKEN.finditer(text):
        mark = token.group()
        if mark.startswith('"'):
            tail = "" if token.group(1) else '"'
        elif mark in _CLOSE:
            stack.append(mark)
            cuts.append((token.end(), tuple(stack)))
        elif mark == ",":
            cuts.append((token.start(), tuple(stack)))
        elif stack:
            stack.pop()
    # from the end backwards: as little as possible is dropped
    tries = [(len(text), tuple(stack), tail)] + [(end, open_, "") for end, open_ in reversed(cuts)]
    for end, open_, quote in tries:
        body = text[:end]
        if quote and body.endswith("\\"):
            body = body[:-1]
        whole = body + quote + "".join(_CLOSE[c] for c in reversed(open_))
        if _object_of(whole):
            return whole
    return None


def _object_of(text: str) -> dict | None:
    """The object that a text holds; None for anything else."""
    try:
        value = json.loads(text, parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _recovered(text: str | None) -> tuple[str | None, bool]:
    if text is None:
        return None, False
    found = first_object(text)
    whole = _object_of(found)
    if whole is not None:
        return _dumped(whole), False
    # quotes, comments and bare texts first, then the structure; a prefix is taken only of what has no fault but an open end
    for reading in (requoted(text), found) if found.startswith("{") else ():
        fixed = patched(reading)
        fixed = None if fixed is None else mended(fixed)
        if fixed is not None:
            return _dumped(_object_of(fixed)), True
    return None, False


def _dumped(value: dict) -> str:
    """JSON as every reader takes it: the last of repeated keys, null for NaN and infinities."""
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def recovered(text: Column) -> Column:
    """``struct(object, repaired)`` of texts that are no clean JSON object."""

    @F.arrow_udf(StructType.fromDDL("object string, repaired boolean"))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in slices(texts):
                objects, repaired = zip(*(_recovered(t) for t in part.to_pylist()))
                yield pa.StructArray.from_arrays([pa.array(objects, pa.string()), pa.array(repaired, pa.bool_())], ["object", "repaired"])

    return found(text)


def answer_object(raw: Column) -> tuple[Column, Column]:
    """The JSON object of an answer and whether it had to be mended.

    Clean objects stay inside the JVM; only the others go through Python.
    """
    text = without_fences(without_thinking(raw))
    clean = text.startswith("{") & F.try_parse_json(text).isNotNull()
    mend = recovered(F.when(~clean, text))
    return F.when(clean, text).otherwise(mend["object"]), F.when(clean, F.lit(False)).otherwise(mend["repaired"])


def kind(value: Column) -> Column:
    """Outer type of a variant, such as ``STRING``, ``OBJECT``, ``ARRAY``."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def text_at(value: Column, path: str) -> Column:
    """The string at a path, trimmed; null for other types and for blank text."""
    found = F.try_variant_get(value, path, "variant")
    text = F.try_variant_get(value, path, "string")
    return F.when(kind(found) == "STRING", string_or_null(text))


def plain_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def objects_at(value: Column, path: str) -> Column:
    """The objects of a list; everything else in it is dropped."""
    return _only(value, path, "OBJECT")


def strings_at(value: Column, path: str) -> Column:
    return F.transform(_only(value, path, "STRING"), lambda v: v.cast("string"))


def _only(value: Column, path: str, wanted: str) -> Column:
    items = F.try_variant_get(value, path, "array<variant>")
    return F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda v: kind(v) == wanted)
