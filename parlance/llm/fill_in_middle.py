"""Fill-in-middle: documents cut into prefix, middle and suffix, their cuts found by a learned rank index.

Tokens are ``[A-Za-z]+|[^A-Za-z]``, so the tokens of a text cover it. The rank index of a text maps a token's rank to the
code point at which it starts: line segments (first rank, offset there, slope) predict the offset of every rank within
``ERROR`` code points, and a byte per rank stores what the prediction misses, so that prediction plus residual is exact. A
segment is grown as far as one slope meets all its ranks' bounds (a shrinking cone). Cuts are looked up by column
expressions: the segment of the rank, its prediction, its residual.

``rank_index`` returns the index as columns, which may be stored; ``transformed`` applies it; ``rebuilt`` is the way back.

Cases: a null text counts as the empty text, which stays plain; a null id is written as no digits; repeated rows are
transformed alike; a text that holds a mark stays plain; an empty table gives an empty result; further columns are kept, those
that bear a name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import words as W

#: Code points that a prediction may miss; a residual must fit a signed byte.
ERROR = 126
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that stay plain, and of the others that put the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"

INDEX = "struct<n:bigint,ranks:array<bigint>,offsets:array<bigint>,slopes:array<double>,residuals:binary>"
_ARROW_INDEX = pa.struct(
    [("n", pa.int64()), ("ranks", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("slopes", pa.list_(pa.float64())), ("residuals", pa.binary())]
)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def boundaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code-point offsets of all token starts and ends of the rows, one after another, and each row's first place among them."""
    raw, borders = W.text_bytes(column)
    lead = (raw & 0xC0) != 0x80
    letter = _LETTER[raw]
    starts = lead.copy()
    starts[1:] &= ~(letter[1:] & letter[:-1])
    inner = borders[:-1][borders[:-1] < len(raw)]
    starts[inner] = True  # a row's first byte; of an empty row, that of a later one
    points = np.concatenate([[0], np.cumsum(lead)])
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, borders)
    # a row of n tokens has n + 1 boundaries: its token starts and its end
    place = first + np.arange(len(borders))
    out = np.zeros(len(at) + len(borders) - 1, dtype=np.int64)
    row = np.repeat(np.arange(len(borders) - 1), np.diff(first))
    out[np.arange(len(at)) + row] = points[at] - points[borders[row]]
    out[place[1:] - 1] = points[borders[1:]] - points[borders[:-1]]
    return out, place


def fitted(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ranks, offsets there and slopes of the segments; each predicts the offsets of its ranks within ``error``."""
    ranks, starts, slopes = [], [], []
    at, count = 0, len(offsets)
    while at < count:
        end, low, high, step = at + 1, -np.inf, np.inf, 256
        while end < count:
            to = min(end + step, count)
            run = np.arange(end - at, to - at, dtype=np.float64)
            rise = offsets[end:to] - offsets[at]
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            open_ = lows <= highs
            met = len(open_) if open_[-1] else int(np.argmin(open_))
            if met:
                low, high = lows[met - 1], highs[met - 1]
            end += met
            if met < len(open_):
                break
            step *= 2
        ranks.append(at)
        starts.append(int(offsets[at]))
        slopes.append(0.0 if end == at + 1 else float((low + high) / 2))
        at = end
    return np.array(ranks, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(slopes, dtype=np.float64)


def _indexed(column: pa.Array) -> pa.Array:
    rows = []
    size = np.diff(W.text_bytes(column)[1])
    # rows in ranges of about a megabyte of text, so that the work arrays stay small
    part = np.concatenate([[0], np.cumsum(size)[:-1]]) >> 20 if len(size) else size
    for low, high in zip(*(np.searchsorted(part, np.unique(part), side=s).tolist() for s in ("left", "right"))):
        offsets, place = boundaries(column.slice(low, high - low))
        for a, b in zip(place[:-1].tolist(), place[1:].tolist()):
            own = offsets[a:b]
            ranks, starts, slopes = fitted(own)
            segment = np.repeat(np.arange(len(ranks)), np.diff(np.append(ranks, len(own))))
            guess = starts[segment] + np.floor(slopes[segment] * (np.arange(len(own)) - ranks[segment])).astype(np.int64)
            # stored as 0 to 255; the floor may miss by one more than the bound
            rows.append({"n": len(own) - 1, "ranks": ranks, "offsets": starts, "slopes": slopes, "residuals": (own - guess + 128).astype(np.uint8).tobytes()})
    return pa.array(rows, _ARROW_INDEX)


def rank_index(text: Column) -> Column:
    """The rank index of a text, as a struct: token count, segments, residuals."""

    @F.arrow_udf(INDEX)
    def indexed(column: pa.Array) -> pa.Array:
        return _indexed(column)

    return indexed(F.coalesce(text, F.lit("")))


def offset_of(index: Column, rank: Column) -> Column:
    """The code point at which token ``rank`` starts; the token count gives the text's length."""
    last = F.size(F.filter(index["ranks"], lambda first: first <= rank))  # the segment of the rank, from 1
    first, start, slope = (F.element_at(index[name], last) for name in ("ranks", "offsets", "slopes"))
    missed = F.conv(F.hex(F.substring(index["residuals"], (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long") - 128
    return start + F.floor(slope * (rank - first)) + missed


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output``: the text in its form, cut where seed and id say."""
    base = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    ours = {}
    for name in ("text", "index", "draws", "cuts"):  # helper names that the table does not use
        ours[name] = f"fim_{name}"
        while ours[name] in base.columns:
            ours[name] += "_"
    text, index, draws, cuts = (F.col(ours[name]) for name in ("text", "index", "draws", "cuts"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))
    work = base.withColumn(ours["text"], F.coalesce(F.col(text_col), F.lit(""))).withColumn(ours["draws"], drawn)
    work = work.withColumn(ours["index"], rank_index(text))
    a, b = draws[0] % (index["n"] + 1), draws[1] % (index["n"] + 1)
    work = work.withColumn(ours["cuts"], F.array(offset_of(index, F.least(a, b)), offset_of(index, F.greatest(a, b))))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (draws[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(draws[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    first, second = cuts[0].cast("int"), cuts[1].cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.lit(2**31 - 1))
    joined = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    joined = joined.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    out = work.withColumn("n", index["n"]).withColumn("form", form)
    out = out.withColumn("prefix_chars", F.when(cut, cuts[0])).withColumn("middle_chars", F.when(cut, cuts[1] - cuts[0])).withColumn("output", joined)
    return out.drop(*ours.values())


def rebuilt(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for. No mark can arise where two parts meet, so the first of each is the one set."""
    length = F.lit(2**31 - 1)

    def parted(rest: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(rest, mark, 1)
        return head, F.substring(rest, F.char_length(head) + len(mark) + 1, length)

    body = F.substring(output, 4, 2**31 - 1)
    prefix, after = parted(body, SUFFIX)
    suffix, middle = parted(after, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, after = parted(body, PREFIX)
    prefix, middle = parted(after, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))
