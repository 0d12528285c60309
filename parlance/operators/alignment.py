"""Word alignment counts and one-to-one label mapping, as Arrow functions."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Pairs of at most so many words are aligned together, so many cells of a diagonal at a time, first within this band.
TOGETHER_WORDS, TOGETHER_CELLS, TOGETHER_BAND = 512, 1 << 15, 32


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """Substitutions, insertions, deletions and hits of a minimal alignment.

    Equal words always align; otherwise substitution is preferred to deletion, deletion to insertion. Cells further
    from the diagonal than the cost are on no minimal alignment, so a band is enough; it widens until it holds the
    cost it finds. Work follows the words times the errors.
    """
    n, m = len(ref), len(hyp)
    if n == 0 or m == 0:
        return 0, m, n, 0
    index: dict[str, int] = {}
    r = np.array([index.setdefault(w, len(index)) for w in ref])
    h = np.array([index.setdefault(w, len(index)) for w in hyp])
    band = abs(n - m) + 128
    while True:
        subs, ins, dels = _within_band(r, h[::-1], band)
        if subs + ins + dels <= band or band >= max(n, m):
            return subs, ins, dels, n - subs - dels
        band *= 4


def _within_band(r: np.ndarray, h: np.ndarray, band: int) -> tuple[int, int, int]:
    """The counts over cells ``(i, j)`` with ``|i - j| <= band``; ``h`` is reversed.

    The table is walked by anti-diagonals, vectorised; every cell carries its cost and its counts, so memory is linear
    in the number of words.
    """
    n, m = len(r), len(h)
    far, cut = n + m + 1, band < max(n, m)
    # Position i of a diagonal k is the cell (i, k - i); rows: cost, substitutions, insertions, deletions.
    table = [np.zeros((4, n + 2), dtype=np.int64) for _ in range(3)]
    table[1][0, :2] = 1
    table[1][2, 0] = table[1][3, 1] = 1
    step = np.array([[0], [1], [2], [3]])
    for k in range(2, n + m + 1):
        before, last, now = table
        lo, hi = max(1, k - m, (k - band + 1) // 2), min(n, k - 1, (k + band) // 2)
        if cut:
            now[0, lo - 1] = now[0, hi + 1] = far
        if k <= min(m, band):
            now[:, 0] = k, 0, k, 0
        if k <= min(n, band):
            now[:, k] = k, 0, 0, k
        diagonal, up, left = before[:, lo - 1 : hi], last[:, lo - 1 : hi], last[:, lo : hi + 1]
        same = r[lo - 1 : hi] == h[m - k + lo : m - k + hi + 1]
        cross = same | ((diagonal[0] <= up[0]) & (diagonal[0] <= left[0]))
        drop = up[0] <= left[0]
        kind = np.where(cross, np.where(same, 0, 1), np.where(drop, 3, 2))
        chosen = np.where(cross, diagonal, np.where(drop, up, left))
        now[:, lo : hi + 1] = chosen + ((step == kind) & (step > 0))
        now[0, lo : hi + 1] += kind > 0
        table = [last, now, before]
    _, subs, ins, dels = (int(x) for x in table[1][:, n])
    return subs, ins, dels


def _differing(ref: Sequence[str], hyp: Sequence[str]) -> tuple[list[str], list[str]]:
    """Both sides without the words that they begin and end with in common.

    Equal words always align, so a common end is all hits; behind a common beginning the table holds the same counts as one that
    starts there.
    """
    r, h = list(ref), list(hyp)
    shorter = min(len(r), len(h))
    tail = next((k for k in range(shorter) if r[-1 - k] != h[-1 - k]), shorter)
    head = next((k for k in range(shorter - tail) if r[k] != h[k]), shorter - tail)
    return r[head : len(r) - tail], h[head : len(h) - tail]


def edit_counts_of(pairs: Sequence[tuple[Sequence[str], Sequence[str]]]) -> list[tuple[int, int, int, int]]:
    """``edit_counts`` of many pairs, from where they first differ to where they last do.

    Short ones are aligned together, those of like lengths in one table: within a narrow band first, those that cost more in a whole one.
    """
    sizes = [len(r) for r, _ in pairs]
    pairs = [_differing(r, h) for r, h in pairs]
    out: list[tuple[int, int, int, int]] = [(0, len(h), len(r), 0) for r, h in pairs]
    short = []
    for at, (r, h) in enumerate(pairs):
        if len(r) and len(h):
            if max(len(r), len(h)) <= TOGETHER_WORDS:
                short.append(at)
            else:
                out[at] = edit_counts(r, h)
    short.sort(key=lambda at: (-(-len(pairs[at][0]) // 16), len(pairs[at][1])))
    begin = 0
    while begin < len(short):
        n, end = 0, begin
        while end < len(short):  # as many pairs as a table's diagonal holds cells
            n = max(n, len(pairs[short[end]][0]))
            if end > begin and (end + 1 - begin) * (n + 1) > TOGETHER_CELLS:
                break
            end += 1
        group = short[begin:end]
        band = max(abs(len(pairs[at][0]) - len(pairs[at][1])) for at in group) + TOGETHER_BAND
        for at, found in zip(group, _together([pairs[at] for at in group], band)):
            out[at] = found
        wider = [at for at in group if sum(out[at][:3]) > band]
        for at, found in zip(wider, _together([pairs[at] for at in wider]) if wider else ()):
            out[at] = found
        begin = end
    return [(s, i, d, size - s - d) for (s, i, d, _), size in zip(out, sizes)]


def _together(pairs: list[tuple[Sequence[str], Sequence[str]]], band: int | None = None) -> list[tuple[int, int, int, int]]:
    """The counts of pairs of at least a word and at most ``TOGETHER_WORDS``, one column of the table each.

    The walk is that of ``_within_band``, over all cells where there is no band. A cell packs cost, substitutions, insertions and
    deletions, 15 bits each; each count is at most the number of words. A pair's own last cell lies on the diagonal of its lengths.
    """
    sizes = [(len(r), len(h)) for r, h in pairs]
    n, m = max(a for a, _ in sizes), max(b for _, b in sizes)
    index: dict[str, int] = {}
    r, h = (np.full((length, len(pairs)), fill, dtype=np.int32) for length, fill in ((n, -1), (m, -2)))
    for column, (a, b) in enumerate(pairs):
        r[: len(a), column] = [index.setdefault(w, len(index)) for w in a]
        h[m - len(b) :, column] = [index.setdefault(w, len(index)) for w in b][::-1]
    one = 1 << 45
    subs, ins, dels = one + (1 << 30), one + (1 << 15), one + 1
    ends: dict[int, list[int]] = {}
    for column, (a, b) in enumerate(sizes):
        ends.setdefault(a + b, []).append(column)
    last_cells = np.zeros(len(pairs), dtype=np.int64)
    table = [np.zeros((n + 2, len(pairs)), dtype=np.int64) for _ in range(3)]
    table[1][0], table[1][1] = ins, dels
    lengths = np.array([a for a, _ in sizes])
    band = max(n, m) if band is None else band
    far, cut = (n + m + 1) * one, band < max(n, m)
    for k in range(2, max(ends) + 1):
        before, last, now = table
        lo, hi = max(1, k - m, (k - band + 1) // 2), min(n, k - 1, (k + band) // 2)
        if cut:
            now[lo - 1] = now[hi + 1] = far
        if k <= min(m, band):
            now[0] = k * ins
        if k <= min(n, band):
            now[k] = k * dels
        diagonal, up, left = before[lo - 1 : hi], last[lo - 1 : hi], last[lo : hi + 1]
        same = r[lo - 1 : hi] == h[m - k + lo : m - k + hi + 1]
        costs = diagonal >> 45, up >> 45, left >> 45
        cross = (costs[0] <= costs[1]) & (costs[0] <= costs[2])
        other = np.where(cross, diagonal + subs, np.where(costs[1] <= costs[2], up + dels, left + ins))
        now[lo : hi + 1] = np.where(same, diagonal, other)
        for column in ends.get(k, ()):
            last_cells[column] = now[lengths[column], column]
        table = [last, now, before]
    part = (1 << 15) - 1
    found = zip(((last_cells >> 30) & part).tolist(), ((last_cells >> 15) & part).tolist(), (last_cells & part).tolist(), lengths.tolist())
    return [(s, i, d, a - s - d) for s, i, d, a in found]


def edit_counts_udf():
    """Column function ``(ref words, hyp words) -> struct`` of the alignment counts."""

    @F.pandas_udf(
        StructType.fromDDL("substitutions long, insertions long, deletions long, hits long")
    )
    def counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        found = edit_counts_of(list(zip(ref, hyp)))
        return pd.DataFrame(found, columns=["substitutions", "insertions", "deletions", "hits"], dtype="int64")

    return counts


def best_mapping(refs: list[str], hyps: list[str], overlap: dict[tuple[str, str], float]) -> dict[str, str]:
    """One-to-one mapping of sorted labels with the most shared time, exact for any number of labels.

    Of equal totals the first in label order counts. Pairs without overlap are left out. Shared times count in whole
    nanoseconds. Memory follows the pairs that overlap; prices and paths never leave a connected part of them.
    """
    flip = len(refs) > len(hyps)
    few, many = (hyps, refs) if flip else (refs, hyps)
    place = {label: j for j, label in enumerate(many)}
    row_of = {label: i for i, label in enumerate(few)}
    gains: list[dict[int, int]] = [{} for _ in few]
    for (ref, hyp), seconds in overlap.items():
        gain = round((seconds or 0.0) * 1e9)
        if gain > 0:
            a, b = (hyp, ref) if flip else (ref, hyp)
            gains[row_of[a]][place[b]] = gain
    rows, columns, matched = _prices(gains, len(many))
    found = _first_of_the_best(gains, rows, columns, matched)
    pairs = {}
    for i, j in enumerate(found):
        if j in gains[i]:
            ref, hyp = (many[j], few[i]) if flip else (few[i], many[j])
            pairs[ref] = hyp
    return pairs


def _prices(gains: list[dict[int, int]], n_columns: int) -> tuple[list[int], list[int], list[int]]:
    """Prices of rows and columns that prove a matching best, and that matching (-1: row left out).

    A row and a column cost together at least their gain, and exactly that where they are matched; who is left out
    costs nothing. Rows join one by one along the cheapest alternating path, which ends at a free column or leaves out
    another row.
    """
    row_price = [max(g.values(), default=0) for g in gains]
    column_price, owner, of_row = [0] * n_columns, [-1] * n_columns, [-1] * len(gains)
    for new in range(len(gains)):
        reached, parent, settled = {new: 0}, {}, {}
        heap: list[tuple[int, int, int]] = []
        end, left_out = row_price[new], new
        column = -1
        at, row = 0, new
        while True:
            for j, gain in gains[row].items():
                if j not in settled:
                    heapq.heappush(heap, (at + row_price[row] + column_price[j] - gain, j, row))
            while heap and heap[0][1] in settled:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            at, j, came = heapq.heappop(heap)
            settled[j], parent[j] = at, came
            if owner[j] < 0:
                end, column = at, j
                break
            row = owner[j]
            reached[row] = at
            if at + row_price[row] < end:
                end, left_out = at + row_price[row], row
        for i, distance in reached.items():
            row_price[i] -= max(0, end - distance)
        for j, distance in settled.items():
            column_price[j] += max(0, end - distance)
        if column < 0:  # the row that is left out hands its column on
            column, of_row[left_out] = of_row[left_out], -1
        while column >= 0:
            row = parent[column]
            owner[column], of_row[row], column = row, column, of_row[row]
    return row_price, column_price, of_row


def _first_of_the_best(gains: list[dict[int, int]], rows: list[int], columns: list[int], matched: list[int]) -> list[int]:
    """A column for every row, the first in row, then column order of all with the best total.

    Rows and columns meet where prices equal gains, and rows without a price meet any column without one (a pair that
    shares nothing). Columns that no row takes stand empty, which only those without a price may.
    """
    zero = [j for j, price in enumerate(columns) if price == 0]
    tight = [sorted(j for j, g in gain.items() if rows[i] + columns[j] == g) for i, gain in enumerate(gains)]
    of_row, holder = list(matched), [-1] * len(columns)
    for i, j in enumerate(of_row):
        if j >= 0:
            holder[j] = i
    spare = (j for j, i in enumerate(holder) if i < 0)
    for i, j in enumerate(of_row):
        if j < 0:
            of_row[i] = next(spare)
    for i, j in enumerate(of_row):
        holder[j] = i

    def moved(displaced: int, goal: int, taken: int, after: int) -> bool:
        """Whether ``displaced`` (-1: an empty place) finds a column, others after ``after`` moving on, until ``goal`` is filled."""
        come, spread, queue = {taken: -2}, False, [displaced]
        for now in queue:
            ways = list(tight[now]) if now >= 0 else []
            if (now < 0 or rows[now] == 0) and not spread:
                spread, ways = True, ways + zero
            for j in ways:
                if j in come or (j != goal and 0 <= holder[j] <= after):
                    continue
                come[j] = now
                if j == goal:
                    path = [j]
                    while come[path[-1]] != displaced:
                        path.append(column_of[come[path[-1]]])
                    for j in path:
                        holder[j] = come[j]
                        if come[j] >= 0:
                            of_row[come[j]] = j
                    return True
                if holder[j] not in column_of:
                    column_of[holder[j]] = j
                    queue.append(holder[j])
        return False

    for i in range(len(of_row)):
        choices = tight[i] if rows[i] else heapq.merge(tight[i], zero)
        for j in choices:
            own, other = of_row[i], holder[j]
            if j >= own:
                break
            if 0 <= other < i:
                continue
            column_of: dict[int, int] = {other: j}
            if moved(other, own, j, i):
                of_row[i], holder[j] = j, i
                break
    return of_row
