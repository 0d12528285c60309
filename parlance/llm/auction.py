"""Cheapest edits of conversations by the auction algorithm for shortest paths, many conversations at a time.

A conversation of m rows is a lattice of m + 1 layers with four states: nothing written, system written, last a user, last an
assistant. Edits are arcs with integer costs. Every node has a price that never exceeds its distance to the end. A path grows
from its origin: where the price of its last node is below the cheapest arc's cost plus the price behind it, the price rises
to that and the path loses its last arc (contraction), else it takes that arc (extension), until it meets the end. Then the origin's
price is its distance, and the arcs whose cost is the difference of their prices are the tight ones: the tight paths to the end are
the cheapest ones, and of these the least letters are followed.

Lattices are auctioned in blocks of ``BLOCK`` layers from the last to the first. Of a block the four states at its first layer are
origins, one after another over the same prices; their distances are the prices at the end of the block before. All conversations
of a batch make their steps together, as arrays.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32
FAR = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: What the first letters of roles stand for; all others are OTHER.
INITIALS, OTHER = {"s": 0, "u": 1, "a": 2}, 3
SOUND, TRUNCATED, FORCED = range(3)
LETTERS = b"DIKR"  # in ASCII order, as ties go
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
#: Distances from the states behind the last row: what is still to be inserted there, and the letters for it.
TAIL = np.array([0, 2 * INSERT_COST, INSERT_COST, 0], dtype=np.int64)
TAIL_LETTERS = ("", "II", "I", "")

# where a written user or assistant leads, and where a kept row does, by its initial
_WRITTEN = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: States from which a state can be reached.
_REACHES = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Cost and node step (four nodes a layer) of each letter, by kind of row (initial * 3 + fault) and state."""
    cost, step = np.full((12, 4, 4), FAR, dtype=np.int64), np.zeros((12, 4, 4), dtype=np.int64)
    for kind in range(12):
        initial, fault = divmod(kind, 3)
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for state in range(4):
            cost[kind, state, 0], step[kind, state, 0] = DELETE_COST, 4 + state
            cost[kind, state, 1], step[kind, state, 1] = INSERT_COST, _WRITTEN[state]
            if fault != FORCED:
                if (state, initial) in _KEPT:
                    cost[kind, state, 2], step[kind, state, 2] = extra, 4 + _KEPT[state, initial]
                cost[kind, state, 3], step[kind, state, 3] = REROLE_COST + extra, 4 + _WRITTEN[state]
    return cost, step


COST, STEP = _arcs()
LEAST = np.array([DELETE_COST if kind % 3 else 0 for kind in range(12)], dtype=np.int64)  # of any edit of such a row


def _auction(kinds: np.ndarray, length: np.ndarray, price: np.ndarray, origin: int) -> None:
    """Raise ``price`` (a row of nodes per lattice) until a tight path leads from ``origin`` to the end of each lattice."""
    count = len(length)
    node = np.full(count, origin, dtype=np.int64)
    depth = np.zeros(count, dtype=np.int64)
    path = np.zeros((count, price.shape[1]), dtype=np.int64)
    live = np.flatnonzero(price[:, origin] < FAR)
    while len(live):
        at = node[live]
        layer, state = at >> 2, at & 3
        kind = kinds[live, layer]
        ahead = (layer << 2)[:, None] + STEP[kind, state]
        worth = COST[kind, state] + price[live[:, None], ahead]
        arc = worth.argmin(axis=1)
        best = worth[np.arange(len(live)), arc]
        low = price[live, at] < best
        rows, back = live[low], depth[live[low]] > 0
        price[rows, at[low]] = best[low]
        depth[rows] -= back
        rows = rows[back]
        node[rows] = path[rows, depth[rows]]
        rows = live[~low]
        path[rows, depth[rows]] = at[~low]
        depth[rows] += 1
        node[rows] = ahead[~low, arc[~low]]
        live = live[(node[live] >> 2 < length[live]) & (price[live, origin] < FAR)]


def _choices(kinds: np.ndarray, length: np.ndarray, price: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least letter of a tight arc on a tight path to the end, of each node; 4 where there is none."""
    count, layers = kinds.shape
    chosen = np.full((count, layers, 4), 4, dtype=np.uint8)
    price = price.reshape(count, layers + 1, 4)
    good = np.zeros((count, 4), dtype=bool)
    at_end = end < FAR
    for layer in range(layers - 1, -1, -1):
        good = np.where((length == layer + 1)[:, None], at_end, good)
        cost, step = COST[kinds[:, layer]], STEP[kinds[:, layer]]
        here, there = price[:, layer], price[:, layer + 1]
        each = np.arange(count)[:, None]
        now = np.zeros((count, 4), dtype=bool)
        letters = np.full((count, 4), 4, dtype=np.uint8)
        for letter in (3, 2, 0):
            to = step[:, :, letter] & 3
            tight = (cost[:, :, letter] < FAR) & (here == cost[:, :, letter] + there[each, to]) & good[each, to] & (here < FAR)
            letters[tight] = letter
            now |= tight
        for _ in range(2):  # insertions stay in the layer: nothing written, user, assistant
            for state in (USER, ASSISTANT, START, SYSTEM):
                to = _WRITTEN[state]
                tight = (here[:, state] == INSERT_COST + here[:, to]) & now[:, to] & (here[:, state] < FAR)
                letters[tight & (letters[:, state] > 1), state] = 1
                now[:, state] |= tight
        inside = layer < length
        chosen[inside, layer] = letters[inside]
        good = np.where(inside[:, None], now, good)
    return chosen


class Lattices:
    """Lattices of several pieces: ``kinds`` of all their rows and the place of each piece's first row among them."""

    def __init__(self, kinds: np.ndarray, first: np.ndarray):
        self.kinds, self.first = kinds.astype(np.int64), first
        self.size = np.diff(first)
        self.blocks = -(-self.size // BLOCK)

    def _block(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that have the block, kinds of its rows, its length."""
        own = np.flatnonzero(self.blocks > number)
        length = np.minimum(self.size[own] - number * BLOCK, BLOCK)
        place = self.first[own][:, None] + number * BLOCK + np.arange(BLOCK)
        kinds = np.where(np.arange(BLOCK) < length[:, None], self.kinds[np.minimum(place, max(0, len(self.kinds) - 1))], 0)
        return own, kinds, length

    def distances(self, end: np.ndarray, origins: tuple[int, ...] = (0, 1, 2, 3), choices: list | None = None) -> np.ndarray:
        """Distances from the states before each piece (of ``origins``) to behind it, where ``end`` is still to go; fills ``choices`` by block."""
        end = end.astype(np.int64).copy()
        for number in range(int(self.blocks.max(initial=0)) - 1, -1, -1):
            own, kinds, length = self._block(number)
            behind = end[own]
            least = np.where(np.arange(BLOCK) < length[:, None], LEAST[kinds], 0)
            rest = np.cumsum(least[:, ::-1], axis=1)[:, ::-1]
            price = np.zeros((len(own), BLOCK + 1, 4), dtype=np.int64)
            price[:, :BLOCK] = rest[:, :, None]
            for state in range(4):  # no more than what follows must cost
                price[:, :, state] += behind[:, _REACHES[state]].min(axis=1)[:, None]
            price[np.arange(len(own)), length] = behind
            price = np.minimum(price, FAR).reshape(len(own), -1)
            for origin in origins if number == 0 else range(4):
                _auction(kinds, length, price, origin)
            end[own] = np.minimum(price[:, :4], FAR)
            if choices is not None:
                choices.append((own, length, _choices(kinds, length, price, behind), kinds))
        if choices is not None:
            choices.reverse()
        return end

    def traced(self, choices: list, entry: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Letters of the cheapest edits from each piece's entry state, ties by the least letter, and the states behind the pieces."""
        state = entry.astype(np.int64).copy()
        who, what = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint8)]
        for own, length, chosen, kinds in choices:
            layer, here = np.zeros(len(own), dtype=np.int64), state[own]
            live = np.flatnonzero(length > 0)
            while len(live):
                letter = chosen[live, layer[live], here[live]]
                live, letter = live[letter < 4], letter[letter < 4]  # states that no path of the whole lattice meets
                ahead = STEP[kinds[live, layer[live]], here[live], letter]
                who.append(own[live])
                what.append(letter)
                layer[live] += ahead >> 2
                here[live] = ahead & 3
                live = live[layer[live] < length[live]]
            state[own] = here
        who, what = np.concatenate(who), np.concatenate(what)
        order = np.argsort(who, kind="stable")
        letters = np.frombuffer(LETTERS, dtype=np.uint8)[what[order]].tobytes()
        border = np.searchsorted(who[order], np.arange(len(self.size) + 1)).tolist()
        return [letters[a:b] for a, b in zip(border[:-1], border[1:])], state

    def matrices(self) -> np.ndarray:
        """Distances from every state before a piece to every state behind it."""
        out = np.full((len(self.size), 4, 4), FAR, dtype=np.int64)
        for to in range(4):
            end = np.full((len(self.size), 4), FAR, dtype=np.int64)
            end[:, to] = 0
            out[:, :, to] = self.distances(end)
        return out
