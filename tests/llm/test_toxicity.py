"""Decoding, rules on planted words, and held-out accuracy on the given labels."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import toxicity as T

BAD = ["stupid", "worthless", "pathetic"]
DISGUISED = ["5tup1d", "s.t.u.p.i.d", "s t u p i d", "stuuuuupid", "w0rthle$$", "p4thet!c", "PATHETIC!!", "$tup!d,"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["the", "an", "er", "in", "on", "ti", "ha", "es"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    hard = [(2000 + i, " ".join([word() for _ in range(10)] + [w] + [word() for _ in range(10)])) for i, w in enumerate(DISGUISED)]
    odd = [(3000, None), (3001, ""), (None, "clean words"), (3002, "1234 55.5 -- ..."), (3003, "a " * 500), (3004, "stupid")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows + hard + odd], "doc_id long, text string, score string").repartition(3)
    return docs, spark.createDataFrame(labels + [(None, 1), (7000, None), (1, 0)], "doc_id long, toxic int")


def test_decoding(planted):
    docs, _ = planted
    decoder = T.Decoder(T.character_model(docs))
    for word in DISGUISED:
        assert any(bad in T.restore_text(word, decoder).lower() for bad in BAD), word
    for word in ("theanin", "555-1234", "12.5", "", "hahaes"):
        assert T.restore_text(word, decoder) == word
    restored = T.restored(docs, T.character_model(docs))
    assert restored.columns == docs.columns and "stupid" in restored.filter("doc_id = 2002").first().text


def test_planted_words_are_found(planted):
    docs, labels = planted
    rows = {r.doc_id: r for r in T.scores(docs, labels).collect()}
    assert all(rows[i].score >= 0.5 for i in range(2000, 2000 + len(DISGUISED)))
    assert all((rows[i].score >= 0.5) == (i % 6 == 0) for i in range(900))
    assert rows[3004].score >= 0.5 and all(rows[i].score < 0.5 for i in (3000, 3001, 3002, 3003, None))
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900)) and not rows[None].held_out


GATED = [
    "you are a s t u p i d", "I s t u p i d", "s t u p i d y", "y o s t u p i d e a", "s - t - u - p - i - d", "s · t · u · p · i · d", "s t u p ! d",
    "stup¡d", "s·t·u·p·i·d", "§tupid", "w0rthle§§", "patthetic", "so (stupid)", "wörthless b l ö d e r", "!diotic", "(razy", "¡stupid!", "$tupid!",
]


def test_gate_is_as_wide_as_the_channel(spark, planted):
    docs, labels = planted
    rng = random.Random(4)
    clean = [r.text.split() for r in docs.filter("doc_id < 900 and doc_id % 6 > 0").sort("doc_id").collect()]
    also = [(4000 + i, " ".join([*rng.sample(rng.choice(clean), 30), w])) for i, w in enumerate(["blöder", "idiotic", "crazy"] * 60)]
    more = spark.createDataFrame([(a, b, "x") for a, b in also + [(5000 + i, "the an " + w) for i, w in enumerate(GATED)]], docs.schema)
    taught = labels.unionAll(spark.createDataFrame([(i, 1) for i, _ in also], labels.schema))
    rows = {r.doc_id: r.score for r in T.scores(docs.unionAll(more), taught).collect()}
    assert [w for i, w in enumerate(GATED) if rows[5000 + i] < 0.5] == []
    assert all((rows[i] >= 0.5) == (i % 6 == 0) for i in range(900))


def test_without_labels(planted):
    docs, labels = planted
    assert {r.score for r in T.scores(docs, labels.limit(0)).collect()} == {0.0}
    assert T.scores(docs.limit(0), labels).count() == 0


def test_class_share_is_learned_from_the_training_folds(spark, planted):
    docs, _ = planted
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = range(900)
    once = [(i, 0) for i in ids if not held(i)]
    labels = spark.createDataFrame(once + once[:50] + [(i, 1) for i in ids if held(i)], "doc_id long, toxic int")
    assert {r.score for r in T.scores(docs, labels).collect()} == {0.0}  # no label 1 is learned from
    twice = spark.createDataFrame([(i, i % 2) for i, _ in once] + [(i, 1) for i, _ in once if i % 2] * 3, "doc_id long, toxic int")
    plain = spark.createDataFrame([(i, i % 2) for i, _ in once], "doc_id long, toxic int")
    assert sorted(r.score for r in T.scores(docs, twice).collect()) == sorted(r.score for r in T.scores(docs, plain).collect())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    judged = T.scores(docs, labels).filter("held_out").join(labels, "doc_id").select((F.col("score") >= 0.5).cast("int").alias("said"), "toxic").collect()
    right = sum(r.said == r.toxic for r in judged)
    assert right / len(judged) > 0.98


def every_reading(word, flat):
    """The cheapest reading of a word by listing all paths through its lattice."""
    word = re.sub(r"(.)\1{3,}", r"\1\1\1", word.lower(), flags=re.S)
    lengths = [len(run[0]) for run in re.finditer(r"(.)\1*", word, flags=re.S) for _ in run[0]]
    step = lambda two, one, code: -flat[(two * T.SYMBOLS + one) * T.SYMBOLS + code]
    best = []

    def go(at, two, one, last, cost, text):
        if at == len(word):
            best.append((cost + step(two, one, 0) if one else cost, text))
            return
        char = word[at]
        letters = T.STANDS_FOR.get(char) or (char if T.symbol(char) else "")
        swap = T.SWAP if char in T.STANDS_FOR else 0.0
        for letter in letters:
            code = T.symbol(letter)
            go(at + 1, one, code, letter, cost + swap + step(two, one, code), text + letter)
            if letter == last:
                go(at + 1, two, one, last, cost + swap + (T.REPEATED if lengths[at] > 2 else T.DOUBLED), text)
        if char in T.SEPARATORS or char == " ":
            go(at + 1, two, one, "", cost + T.DROP, text)
        elif char not in letters:
            go(at + 1, 0, 0, "", cost + T.KEEP, text + char)

    go(0, 0, 0, "", 0.0, "")
    return min(best)


def test_decoding_like_all_paths():
    rng = np.random.default_rng(9)
    model = np.log(rng.dirichlet(np.ones(T.SYMBOLS) / 4, size=(T.SYMBOLS, T.SYMBOLS)) + 1e-6).astype(np.float32)
    decoder, flat = T.Decoder(model), model.reshape(-1).tolist()
    signs = list("ab1!|0$-._ 6eé@#zz")
    for _ in range(400):
        word = "".join(rng.choice(signs) for _ in range(rng.integers(1, 8)))
        cost, text = every_reading(word, flat)
        got = decoder.judged(word)
        assert got[0] == text and abs(got[1] - cost) < 1e-9, word


def test_repeated_ids_teach_one_text(spark):
    rows = [(i, ("nasty " if i % 2 else "nice ") + f"word{i} and more{i * 7}") for i in range(200)] + [(1, "another text"), (3, "third text"), (None, "nasty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    found = [sorted(((r.doc_id, r.score) for r in T.scores(docs.repartition(n, "text"), labels).collect()), key=repr) for n in (1, 6)]
    assert found[0] == found[1] and dict(found[0])[None] > 0.9
