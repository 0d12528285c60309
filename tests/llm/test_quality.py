"""Terms against plain counting, the vote against plain Python, and held-out accuracy."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_terms_count_shapes_and_repeats():
    texts = ["Ab cd cd", "", None, "x", "AB!! CD!! EF!!", "same same same", "é È 12.5 1,7", "a" * 9000 + " b"]
    counts = Q.counted_terms(pa.array(texts))
    for text, row in zip(texts, counts):
        words = WORD.findall(text or "")
        parts = np.split(row, np.cumsum(Q.SHARES)[:-1])
        assert parts[0].sum() == len(words) == parts[3].sum() and parts[1].sum() == max(0, len(words) - 1)
        assert parts[2].sum() == sum(a.lower() == b.lower() for a, b in zip(words, words[1:]))
    alike = Q.counted_terms(pa.array(["Hello there, 12", "Wonderful abc, 4"]))
    assert (alike[0][: -Q.SHARES[-1]] == alike[1][: -Q.SHARES[-1]]).all()  # shapes, not letters


def test_vote_like_plain_python():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    known, label = unit(rng.normal(size=(90, 8))), rng.integers(0, 2, 90).astype(float)
    known[40:60] = known[10]  # ties beyond the last neighbour
    stands = np.where(label == 1, 3.0, 0.5)
    asked = np.concatenate([unit(rng.normal(size=(1200, 8))), known[10:11], np.zeros((1, 8))])
    got = Q.Neighbours(known, label, stands, 0.25).scores(asked)
    for vector, score in zip(asked, got):
        cosine = [round(float(vector @ k), 6) for k in known]
        last = sorted(cosine, reverse=True)[Q.NEIGHBOURS - 1]
        votes = [(c**Q.SHARPNESS * s, y) for c, s, y in zip(cosine, stands, label) if c >= last and c > 0]
        total = sum(v for v, _ in votes)
        assert math.isclose(score, sum(v * y for v, y in votes) / total if total else 0.25, rel_tol=1e-3, abs_tol=1e-6)


def test_space_covers_all_rows(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Ab", "cd", "EF!!", "12", "x", "x"]) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    space = Q.latent_space(docs)
    counts = Q.counted_terms(pa.array(texts))
    weight = np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1)) + 0.01
    weight[-Q.SHARES[-1] :] *= Q.WORD_WEIGHT
    assert np.allclose(space.weight, weight)
    rows = np.rint(Q.weighted(counts, weight) * Q.GRAIN)
    assert (Q.term_products(docs, weight) == rows.T @ rows).all()
    assert np.allclose(space.vectors(pa.array(texts)) @ space.vectors(pa.array(texts)).T, plain_cosine(rows / Q.GRAIN, Q.weighted(counts, weight)), atol=0.02)


def plain_cosine(rows, exact):
    _, _, directions = np.linalg.svd(rows, full_matrices=False)
    low = exact @ directions[: Q.RANK].T
    low /= np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)
    return low @ low.T


def test_cases(spark):
    good = ["This is a calm text about rivers.", "Another text, with some words in it.", "Plain sentences follow here. They end."]
    bad = ["BUY!! NOW!! CHEAP!!", "###x $$$y ***z &&&", "spam spam spam spam spam"]
    rng = random.Random(1)
    rows = [(i, rng.choice(bad if i % 3 == 0 else good) + " " + rng.choice(bad if i % 3 == 0 else good)) for i in range(120)]
    labels = [(i, 0 if i % 3 == 0 else 1, "x") for i, _ in rows] + [(None, 1, "x"), (5, None, "x"), (7, 1, "x")]
    rows += [(None, None), (None, good[0]), (500, ""), (501, bad[0]), (501, bad[0]), (502, "word " * 50_000)]
    docs = spark.createDataFrame([r + (9, 1.0) for r in rows], "doc_id long, text string, label int, score double").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = Q.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 120 and r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and all((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in held)
    assert len({r.score for r in got if r.doc_id == 501}) == 1 and [r.score for r in got if r.doc_id == 501][0] < 0.7
    empty = {r.score for r in got if r.doc_id == 500}
    assert len(empty) == 1 and 0.5 < empty.pop() < 0.8
    assert {r.score for r in Q.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in Q.scores(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert Q.scores(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    judged = Q.scores(docs, labels).join(labels, "doc_id").filter("held_out and quality is not null")
    right = judged.select(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("double").alias("right"), "quality")
    by = {r.quality: r.share for r in right.groupBy("quality").agg(F.avg("right").alias("share")).collect()}
    assert by[1] >= 0.97 and by[0] >= 0.9
