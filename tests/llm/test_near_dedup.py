"""Near-dedup against all pairs, components against union-find."""

import random
import re

import pytest

from parlance.llm import near_dedup as N
from parlance.llm.components import connected_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, width):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set()))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        lowest = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), lowest, doc_id == lowest))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉfg") for _ in range(4))
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "Two words"), (1004, "two  WORDS"), (1005, "two words more"), (None, "a b c d e f g h"), (1006, "É b c d e"), (1007, "é b c d e")]
    number = 0
    for size in (12, 40, 120, 300):
        base = [word() for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((number, " ".join(copy)))
            number += 1
        rows.append((number, " ".join(base).upper()))
        rows.append((number + 1, " ".join(base)))
        rows.append((None, " ".join(base)))
        number += 2
    return rows


@pytest.mark.parametrize("width,blocks", [(4, 1024), (5, 3)])
def test_like_all_pairs(spark, monkeypatch, width, blocks):
    monkeypatch.setattr(N, "BLOCK", blocks)
    monkeypatch.setattr(N, "TEXT_BLOCK", blocks)
    rows = corpus(width)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, node string").repartition(3)
    got = N.near_duplicates(docs, width, 80).drop("text_hash")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, width)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, i) for i in range(201, 230)] + [(7, 7)]
    top = {x: x for pair in links for x in pair if pair[0] != pair[1]}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(x, find(x)) for x in top}
