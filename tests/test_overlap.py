"""Sweeps against all pairs, with crowded buckets; the plan holds no inequality join."""

import contextlib
import io
import random
import time

import pytest
from pyspark.errors import AnalysisException

from parlance.operators import overlap as O
from parlance.operators.phrases import register_phrase_hits
from parlance.plans.speakers import labelled_segments


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def plain_labels(segments, turns):
    out = []
    for session, pos, start, end, speaker in segments:
        a = start or 0.0
        b = end or a
        best = None
        for other, t0, t1, who in turns:
            if b > a and other == session and None not in (session, t0, t1) and a < t1 and t0 < b:
                rank = (max(0.0, min(b, t1) - max(a, t0)), -t0, -t1)
                if best is None or rank > best[0]:
                    best = (rank, who)
        out.append((session, pos, speaker if best is None or best[1] is None else best[1]))
    return sorted(out, key=repr)


def test_labels_like_all_pairs(spark):
    rng = random.Random(3)
    point = lambda: rng.choice([round(rng.uniform(0, 60), 1), float(rng.randrange(60))])
    segments, turns = [], []
    for pos in range(500):
        start = point()
        segments.append((rng.randrange(4), pos, rng.choice([start, start, None]), rng.choice([start + rng.choice([0.0, 0.5, 3.0, 30.0]), None, 0.0]), f"old{pos % 3}"))
    for n in range(300):
        start = point()
        turns.append((rng.randrange(5), start, start + rng.choice([0.0, 0.3, 2.0, 2.0, 25.0]), f"new{n}"))
    turns += [(1, None, 3.0, "x"), (2, 5.0, None, "y"), (None, 1.0, 2.0, "z"), turns[0]]
    segments.append((None, 900, 1.0, 2.0, "kept"))
    kinds = "session_id int, pos int, start double, end double, speaker string"
    left = spark.createDataFrame(segments, kinds).repartition(3)
    right = spark.createDataFrame(turns, "session_id int, start double, end double, speaker string")
    for bucket_s in (1.0, 7.0, 1000.0):
        got = O.label_by_overlap(left, right, bucket_s)
        assert sorted(map(tuple, got.select("session_id", "pos", "speaker").collect()), key=repr) == plain_labels(segments, turns)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert O.label_by_overlap(left.limit(0), right).count() == 0
    assert sorted(r.speaker for r in O.label_by_overlap(left, right.limit(0)).collect()) == sorted(s[4] for s in segments)


def test_crowded_bucket(spark):
    """Ten thousand rows that all overlap: 25 million pairs, none listed."""
    n = 5000
    segments = spark.range(n).selectExpr("1 session_id", "id pos", "cast(id as double) / 1000 start", "20 + cast(id as double) / 1000 end", "'old' speaker")
    turns = spark.range(n).selectExpr("1 session_id", "cast(id as double) / 500 start", "15 + cast(id as double) / 700 end", "concat('t', id) speaker")
    started = time.time()
    got = {r.pos: r.speaker for r in O.label_by_overlap(segments, turns, 60.0).collect()}
    assert time.time() - started < 60
    for pos in range(0, n, 501):
        a, b = pos / 1000, 20 + pos / 1000
        best = max(range(n), key=lambda i: (min(b, 15 + i / 700) - max(a, i / 500), -i))
        assert abs((min(b, 15 + best / 700) - max(a, best / 500)) - (min(b, 15 + int(got[pos][1:]) / 700) - max(a, int(got[pos][1:]) / 500))) < 1e-9


def test_shared_seconds_like_all_pairs(spark):
    rng = random.Random(5)

    def side(n):
        out = []
        for _ in range(n):
            start = rng.uniform(0, 9000)
            out.append((rng.randrange(3), rng.choice("ab"), start, start + rng.choice([0.0, 1.0, 500.0, 5000.0])))
        return out

    left, right = side(150) + [(7, "a", 1.0, 2.0), (0, "a", None, 5.0)], side(120) + [(8, "a", 1.0, 2.0)]
    want = {}
    for a, b, s0, s1 in left:
        for c, d, t0, t1 in right:
            if (a, b) == (c, d) and s0 is not None and min(s1, t1) > max(s0, t0):
                want[a, b] = want.get((a, b), 0.0) + min(s1, t1) - max(s0, t0)
    kinds = "k int, l string, start double, end double"
    got = O.intersection_seconds(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds), ["k", "l"], 700.0)
    assert "NestedLoop" not in plan_of(got)
    rows = {(r.k, r.l): r.shared_s for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-6 for k in want)


def test_labelled_segments_chain(spark):
    kinds = "session_id int, pos int, start double, end double, speaker string"
    segments = spark.createDataFrame(
        [(s, p, p * 10.0, p * 10.0 + 9.0 - p, "old") for s in (1, 2) for p in range(4)] + [(None, 9, 0.0, 1.0, "lost")], kinds
    )
    turns = spark.createDataFrame(
        [(s, p * 10.0, p * 10.0 + 8.0, f"SPEAKER_0{p}") for s in (1, 2) for p in range(3)], "session_id int, start double, end double, speaker string"
    )
    vectors = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [0.01, 1.0]}
    clusters = spark.createDataFrame([(s, f"SPEAKER_0{p}", v) for s in (1, 2) for p, v in vectors.items()], "session_id int, label string, embedding array<double>")
    failed = spark.createDataFrame([(2,), (2,)], "session_id int")
    got = {(r.session_id, r.pos): r.speaker for r in labelled_segments(segments, turns, clusters, 0.9, failed).collect()}
    # speakers 1 and 2 are one voice of 8 + 7 s, speaker 0 has 9 s, the segment that no turn meets has 6 s
    assert got == {(1, 0): "S1", (1, 1): "USER", (1, 2): "USER", (1, 3): "S2", (None, 9): "lost"} | {(2, p): "old" for p in range(4)}
    apart = {r.pos: r.speaker for r in labelled_segments(segments, turns, clusters).filter("session_id = 1").collect()}
    assert apart == {0: "USER", 1: "S1", 2: "S2", 3: "S3"}
    assert labelled_segments(segments.limit(0), turns, clusters, 0.9).collect() == []


def test_phrase_hits_as_a_table_function(spark):
    register_phrase_hits(spark)
    rows = spark.createDataFrame(
        [(1, "Hey Bo wake up, hey bo stop it", ["hey bo", None, " "], ["stop"]), (2, None, ["a"], []), (3, "a a", None, []), (4, "a b", ["a"], None), (5, "", ["a"], [])],
        "id int, text string, phrases array<string>, stops array<string>",
    )
    got = spark.sql("SELECT id, h.* FROM {rows} r, LATERAL phrase_hits(r.text, r.phrases, r.stops) h", rows=rows).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "hey bo", 0, 6, "Hey Bo wake up,"), (1, 1, "hey bo", 16, 22, "hey bo"), (4, 0, "a", 0, 1, "a b")]
    with pytest.raises(AnalysisException, match="array of strings"):
        spark.sql("SELECT * FROM phrase_hits('a', 'a', array('b'))")
