"""Words and their hashes for whole Arrow batches, without a Python step per word.

A word is a maximal run of bytes other than the six ASCII white-space bytes (0x20, 0x09-0x0D), which is
the same as that rule on characters, since UTF-8 never uses these bytes inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MASK64 = (1 << 64) - 1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP_BYTES = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(count: int, seed: int) -> np.ndarray:
    """``count`` pseudo-random odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        at = np.arange(1, count + 1, dtype=np.uint64) * GOLDEN + np.uint64(int(seed) & MASK64)
    return mix(at) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row borders in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    borders = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[borders[0] : borders[-1]], borders - borders[0]


@dataclass
class Words:
    """Words of consecutive rows: bytes, place and hash of each, and each row's first word."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # rows + 1 entries

    def of(self, row: int) -> slice:
        return slice(self.first[row], self.first[row + 1])


def words_of(column: pa.Array, lower: bool = False, seed: int = 0) -> Words:
    """Split and hash every row; ``lower`` maps A-Z to a-z first (ASCII only)."""
    raw, borders = text_bytes(column)
    if lower and len(raw):
        raw = _LOWER[raw]
    ink = ~_SPACE[raw]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    inner = borders[(borders > 0) & (borders < len(raw))]
    begins[inner] = ink[inner]
    ends[inner - 1] = ink[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(raw, start, end, _hashes(raw, start, end - start, seed), np.searchsorted(start, borders))


def _hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of byte runs, eight bytes of each at a time."""
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(length.astype(np.uint64) * GOLDEN + np.uint64(seed & MASK64))
        rows, at, left = None, start, length
        while len(at):
            part = eight[at] & _KEEP_BYTES[np.minimum(left, 8)]
            if rows is None:
                out = mix((out ^ part) * GOLDEN + (out >> np.uint64(32)))
                rows = np.flatnonzero(left > 8)
            else:
                known = out[rows]
                out[rows] = mix((known ^ part) * GOLDEN + (known >> np.uint64(32)))
                rows = rows[left > 8]
            more = left > 8
            at, left = at[more] + 8, left[more] - 8
    return out


def runs(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash for each ``width`` consecutive entries; entry i covers i .. i + width - 1."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = odd_constants(width, seed)
    with np.errstate(over="ignore"):
        total = np.zeros(count, dtype=np.uint64)
        for j in range(width):
            total += mix(hashes[j : j + count] * factors[j])
        return mix(total)


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``size`` text bytes, at least one row each, so that work arrays stay small."""
    if not batch.num_rows:
        return
    _, borders = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(borders, borders[at] + size, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
