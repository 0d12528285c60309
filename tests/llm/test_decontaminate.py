"""Decontamination against plain-Python greedy string tiling, and planted passages."""

import random

import numpy as np
import pytest

from parlance.llm import decontaminate as D


def greedy(item, doc, least):
    """Greedy string tiling, the slow way."""
    least = max(1, min(least, len(item)))
    used_item, used_doc, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = []
        for a in range(len(item)):
            for b in range(len(doc)):
                k = 0
                while a + k < len(item) and b + k < len(doc) and item[a + k] == doc[b + k] and not used_item[a + k] and not used_doc[b + k]:
                    k += 1
                if k >= least and (not best or k >= best[0][2]):
                    best = ([] if not best or k > best[0][2] else best) + [(a, b, k)]
        if not best:
            return out
        for a, b, k in best:
            if not any(used_item[a : a + k]) and not any(used_doc[b : b + k]):
                used_item[a : a + k] = used_doc[b : b + k] = [True] * k
                out.append((a, b, k))


@pytest.mark.parametrize("seed", range(12))
def test_tiles_like_the_slow_way(seed):
    rng = random.Random(seed)
    item = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
    doc = [rng.randrange(4) for _ in range(rng.randrange(0, 50))]
    got = D.tiles(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64), 3)
    want = greedy(item, doc, 3)
    assert sorted(k for _, _, k in got) == sorted(k for _, _, k in want)


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    items = [words(rng, 30) for _ in range(6)] + [["only", "three", "words"]]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words(rng, 200))))
    rows.append((100, " ".join(words(rng, 50) + items[0] + words(rng, 50))))
    rows.append((101, " ".join(words(rng, 50) + items[1][15:] + words(rng, 9) + items[1][:15])))
    rows.append((102, " ".join(w.upper() + "," for w in items[2])))
    rows.append((103, " ".join(items[3][:8] + words(rng, 50))))
    rows.append((104, "x only three words y"))
    rows += [(105, None), (106, ""), (None, " ".join(items[4])), (107, " ".join(items[5])), (107, "clean text of the same id")]
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, tokens string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(50, None), (51, " ")], "item_id long, text string")
    return docs, bench


def test_planted_passages(planted):
    docs, bench = planted
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (104, 6), (None, 4), (107, 5)}
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [*range(60), 103, 105, 106, 107] and None not in ids


def test_joined_seeds_give_the_same(planted, monkeypatch):
    docs, bench = planted
    shipped = {tuple(r) for r in D.contaminated(docs, bench).collect()}
    monkeypatch.setattr(D, "SHIPPED_SEEDS", 0)
    assert {tuple(r) for r in D.contaminated(docs, bench).collect()} == shipped


def test_joined_seeds_keep_repeated_rows(planted, monkeypatch):
    docs, bench = planted
    docs = docs.unionAll(docs.filter("doc_id in (100, 101) or doc_id is null"))
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    shipped = order(D.contaminated(docs, bench).collect())
    assert len(shipped) == 9
    monkeypatch.setattr(D, "SHIPPED_SEEDS", 0)
    assert order(D.contaminated(docs, bench).collect()) == shipped


def test_empty_tables(planted):
    docs, bench = planted
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == docs.count()
