"""The rank index against plain scanning, and the transformation against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.llm import fill_in_middle as M

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_boundaries_and_segments():
    rng = random.Random(4)
    texts = ["", "a", "é", "ab cd", "\n", "", "x" * 5000 + " " + "é" * 3000 + "abc " * 4000, "𝒳y𝒳"]
    texts += ["".join(rng.choice("ab é\n1𝒳") for _ in range(rng.randrange(300))) for _ in range(200)] + [""]
    offsets, place = M.boundaries(pa.array(texts))
    for k, text in enumerate(texts):
        ends = [0]
        for token in TOKEN.findall(text):
            ends.append(ends[-1] + len(token))
        own = offsets[place[k] : place[k + 1]]
        assert own.tolist() == ends
        ranks, starts, slopes = M.fitted(own)
        at = np.searchsorted(ranks, np.arange(len(own)), side="right") - 1
        assert (np.abs(starts[at] + slopes[at] * (np.arange(len(own)) - ranks[at]) - own) <= M.ERROR + 1e-6).all()
    assert len(M.fitted(np.arange(100_000) * 3)[0]) == 1  # a straight line is one segment
    assert len(M.fitted(np.cumsum(np.where(np.arange(100_000) // 1000 % 2, 1, 40)))[0]) > 50


def test_like_plain_python(spark):
    rng = random.Random(5)
    alphabet = ["a", "Bc", " ", "é", "\n", "\r\n", "<", "P", ">", "<S", "𝒳", "\x00", "word", "<P", "0"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, "a b c"), (None, None), (-5, None), (1000, ""), (1001, "has <M> mark"), (1002, " " * 40000 + "word " * 60000), (7, "again"), (7, "again"), (1 << 62, "big id")]
    docs = spark.createDataFrame([(a, b, "kept", 3.0) for a, b in rows], "doc_id long, text string, fim_index string, n double").repartition(3)
    got = M.transformed(docs)
    assert set(got.columns) == {"doc_id", "text", "fim_index", "n", "form", "prefix_chars", "middle_chars", "output"}
    assert got.filter("fim_index != 'kept'").count() == 0
    got = got.withColumn("back", M.rebuilt(F.col("output"), F.col("form"))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back")
    want = [plain(*r) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert M.transformed(docs.limit(0)).count() == 0


def test_stored_index(spark):
    text = "It is a stored index, é, " * 900
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    stored = docs.select(M.rank_index(F.col("text")).alias("index")).crossJoin(spark.range(0, len(TOKEN.findall(text)) + 1, 97))
    ends = np.concatenate([[0], np.cumsum([len(t) for t in TOKEN.findall(text)])])
    assert all(r.at == ends[r.id] for r in stored.select("id", M.offset_of(F.col("index"), F.col("id")).alias("at")).collect())
