"""The auction against a uniform-cost search, and repaired conversations against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np

from parlance.llm import auction as A
from parlance.llm import repair as R

NEEDS = {"": "u", "s": "u", "u": "a", "a": "u"}  # by the last role written


def cheapest(rows):
    """Cost and letters by uniform-cost search; rows are (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        heapq.heappush(heap, (cost + 5, audit + "I", at, NEEDS[last]))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if initial == NEEDS[last] or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initial))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, NEEDS[last]))


def plain(convs):
    out = []
    for conv_id in {r[0] for r in convs}:
        rows = []
        for _, turn, role, text in (r for r in convs if r[0] == conv_id):
            role, text = (" " if v is None else v for v in (role, text))
            lot = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            rows += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            ink = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        turns = {r[0] for r in rows if r[0] is not None}
        cost, audit = cheapest(list(zip(initials, faults)))
        lines, last, at = [], "", 0
        for letter in audit:
            if letter != "D":
                role = NEEDS[last]
                if letter == "K":
                    role = initials[at]
                last = role
                name = rows[at][1] if letter == "K" else {"u": "user", "a": "assistant"}[role]
                lines.append(f"{name}:{'' if letter == 'I' else rows[at][2]}")
            at += letter != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_auction_like_uniform_cost():
    rng = random.Random(1)
    faults = ["", "truncated", "blank"]
    for _ in range(6):
        convs = [[(rng.choices("suax", [1, 4, 4, 1])[0], rng.choices(faults, [5, 1, 1])[0]) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 31, 32, 33, 64, 65, 150]))] for _ in range(60)]
        kinds = np.array([A.INITIALS.get(i, A.OTHER) * 3 + faults.index(f) for c in convs for i, f in c], dtype=np.int64)
        lattices, choices = A.Lattices(kinds, np.cumsum([0] + [len(c) for c in convs])), []
        costs = lattices.distances(np.repeat(A.TAIL[None], len(convs), 0), (A.START,), choices)[:, A.START]
        audits, states = lattices.traced(choices, np.zeros(len(convs)))
        for conv, cost, audit, state in zip(convs, costs, audits, states):
            assert cheapest(conv) == (cost, audit.decode() + A.TAIL_LETTERS[state])
        for matrix, cost in zip(lattices.matrices(), costs):
            assert min(matrix[A.START] + A.TAIL) == cost


def made(rng):
    texts = ["Yes.", "No!", "what", "ok?", "  ", "", "é.", "a\n.", "same.", None, " ", "end. \t", "x" * 300 + "."]
    convs = []
    for conv_id in [None, *range(60)]:
        many = rng.choice([1, 2, 3, 5, 8, 20, 70])
        for turn in range(many):
            role = rng.choices(["user", "assistant", "system", "tool", None, "", "unknown", "ärger"], [9, 9, 2, 1, 1, 1, 1, 1])[0]
            convs.append((conv_id, rng.choice([turn, turn, turn, 2 * turn, None]), role, rng.choice(texts) if rng.random() < 0.7 else f"text {rng.random()}."))
    convs += [r for r in convs if rng.random() < 0.05]  # repeated rows
    return convs


def test_like_plain_python(spark):
    convs = made(random.Random(2))
    rows = spark.createDataFrame([r + ("k", 1) for r in convs], "conv_id long, turn long, role string, text string, piece string, fault int").repartition(4)
    want = plain(convs)
    assert any(w[7] == "" for w in want) and len({w[6] for w in want}) > 8
    names = ["conv_id", "gaps", *R.COUNTS, "audit", "repaired_sha256"]
    for limits in ({}, {"row_limit": 7}, {"row_limit": 1, "byte_limit": 500}):
        got = R.repair_reports(rows, **limits).select(*names)
        assert sorted(map(tuple, got.collect()), key=repr) == want, limits
    assert R.repair_reports(rows.limit(0)).count() == 0


def test_one_hot_row(spark):
    """A row that occurs very often travels once, and only its first copy stays."""
    convs = [(5, 1, "user", "Hello.")] * 3000 + [(5, 2, "assistant", "Hi.")] * 2000 + [(6, 1, "user", "a."), (6, 2, "assistant", "b.")]
    got = {r.conv_id: r for r in R.reports(R.repaired(spark.createDataFrame(convs, "conv_id long, turn long, role string, text string"), row_limit=100)).collect()}
    assert got[5].audit == "K" + "D" * 2999 + "K" + "D" * 1999 and got[5].cost == 2 * 4998 and got[5].duplicate == 4998
    assert got[6].audit == "KK" and got[5].repaired_sha256 == hashlib.sha256(b"user:Hello.\nassistant:Hi.").hexdigest()
