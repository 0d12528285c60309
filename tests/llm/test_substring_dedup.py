"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from parlance.llm import substring_dedup as S


def brute(rows, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    lowest = {}
    key = [float("inf") if i is None else i for i, _ in rows]
    for k, words in zip(key, split):
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            lowest[w] = min(lowest.get(w, k), k)
    out = []
    for (doc_id, _), k, words in zip(rows, key, split):
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if lowest[tuple(words[i : i + width])] < k:
                gone[i : i + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "γάμμα", "d", "e,f", "Gg", "h" * 30, "i", "j", "kk"])
    text = lambda n: [word() for _ in range(n)]
    passage = text(40)
    rows = []
    for i in range(80):
        words = text(rng.randrange(0, 60))
        if i % 3 == 0:
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = passage[rng.randrange(0, 10) :]
        rows.append((i * 5 % 83, rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, rows[4][1]), (203, rows[5][1]), (None, rows[6][1]), (None, " ".join(passage)), (204, "same " * 100), (205, "same " * 90)]
    return rows


@pytest.mark.parametrize("hot", [4_000, 5])
@pytest.mark.parametrize("width", [13, 6])
def test_like_brute_force(spark, monkeypatch, hot, width):
    monkeypatch.setattr(S, "BLOCK_CHARS", 700)
    rows = corpus(hot + width)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, block int").repartition(3)
    got = sorted(map(tuple, S.without_shared_windows(docs, width, hot=hot).collect()), key=repr)
    assert got == brute(rows, width)


def test_empty_table(spark):
    assert S.without_shared_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
