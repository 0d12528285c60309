"""Hand-computed cases and brute-force checks of the interval and frame operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import intervals as iv
from parlance.operators.scans import Scan, interval_islands, island_ids, prefix_scan
from parlance.plans import segmentation as seg
from parlance.sources import capture

def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def cuts_by_second(duration, silences, gap):
    """Conversations of a capture in whole seconds: what is left of silences of at least ``gap`` seconds."""
    quiet = set()
    for start, end in silences:
        if end - start >= gap:
            quiet.update(range(start, min(end, duration)))
    out, begin = [], None
    for second in range(duration + 1):
        loud = second < duration and second not in quiet
        if loud and begin is None:
            begin = second
        if not loud and begin is not None:
            out.append((begin, second))
            begin = None
    return out


def test_conversation_cuts_equal_seconds(spark):
    rng = random.Random(11)
    cases = {"still": (0, []), "whole": (77, []), "mute": (77, [(0, 77)])}
    for number in range(40):
        at, silences = 0, []
        while at < 900:
            start = at + rng.randrange(0, 130)
            at = start + rng.randrange(1, 120)
            silences.append((start, at))
            at += 1
        cases[f"c{number}"] = (at - rng.randrange(0, 2) * 40, [(s, min(e, at)) for s, e in silences])
    cases = {k: (d, [(s, min(e, d)) for s, e in q if s < d]) for k, (d, q) in cases.items()}
    sessions = spark.createDataFrame([(k, float(v[0])) for k, v in cases.items()], "session_id string, duration_s double")
    silences = spark.createDataFrame(
        [(k, float(s), float(e)) for k, v in cases.items() for s, e in v[1]], "session_id string, start double, end double"
    )
    found = seg.conversations_from_silences(sessions, silences, 60.0)
    want = [(k, i, float(s), float(e)) for k, v in cases.items() for i, (s, e) in enumerate(cuts_by_second(*v, 60))]
    assert rows(found, "session_id", "idx", "start", "end") == sorted(want)


def test_padding_stays_inside(spark):
    sessions = spark.createDataFrame([("p", 310.0)], "session_id string, duration_s double")
    silences = spark.createDataFrame([("p", 71.0, 160.0), ("p", 230.0, 310.0)], "session_id string, start double, end double")
    found = seg.conversations_from_silences(sessions, silences, 60.0, pad_s=2.0)
    assert rows(found, "start", "end") == [(0.0, 73.0), (158.0, 232.0)]


def frames(spark, blocks):
    data = []
    for name, parts in blocks.items():
        probs = [p for n, p in parts for _ in range(n)]
        data += [(name, i, p) for i, p in enumerate(probs)]
    return spark.createDataFrame(data, "session_id string, frame_idx long, prob double")


def test_hysteresis_equals_a_state_machine(spark):
    rng = random.Random(7)
    probs = {s: [rng.random() for _ in range(300)] for s in "abc"}
    df = spark.createDataFrame(
        [(s, i, p) for s, ps in probs.items() for i, p in enumerate(ps)], "session_id string, frame_idx long, prob double"
    )
    got = rows(seg.speech_regions(df, 1.0, 0.7, 0.3, chunk_frames=16), "session_id", "start", "end")
    want = []
    for s, ps in probs.items():
        begin = None
        for i, p in enumerate(ps + [0.0]):
            if begin is None and p >= 0.7:
                begin = i
            elif begin is not None and (p < 0.3 or i == len(ps)):
                want.append((s, float(begin), float(i)))
                begin = None
    assert got == sorted(want)
    with pytest.raises(ValueError):
        seg.speech_regions(df, 1.0, 0.3, 0.7)


def quiet_by_frame(probs, rise=0.5, fall=0.35, bridge=5, least=3):
    """Silent frame runs: speech by two thresholds, short pauses bridged, then short speech dropped."""
    speech, on = [], False
    for p in probs:
        on = p >= fall if on else p >= rise
        speech.append(on)
    runs = [[on, len(list(part))] for on, part in itertools.groupby(speech)]
    for i, (on, size) in enumerate(runs):
        if not on and 0 < i < len(runs) - 1 and size < bridge:
            runs[i][0] = True
    runs = [[on, sum(n for _, n in part)] for on, part in itertools.groupby(runs, lambda r: r[0])]
    at, out = 0, []
    for on, size in runs:
        if not on or size < least:
            if out and out[-1][1] == at:
                out[-1] = (out[-1][0], at + size)
            else:
                out.append((at, at + size))
        at += size
    return [(a, b) for a, b in out if b - a >= bridge]


def test_silences_equal_a_frame_walk(spark):
    rng = random.Random(23)
    blocks = {}
    for number in range(30):
        parts = [(rng.randrange(1, 12), rng.choice([0.05, 0.4, 0.8])) for _ in range(rng.randrange(1, 14))]
        blocks[f"s{number}"] = parts
    probs = {k: [p for n, p in v for _ in range(n)] for k, v in blocks.items()}
    durations = spark.createDataFrame([(k, len(v) * 0.1) for k, v in probs.items()] + [("gone", 0.0)], "session_id string, duration_s double")
    found = seg.silences_from_frames(frames(spark, blocks), durations, frame_s=0.1, min_silence_s=0.45, min_speech_s=0.25)
    got = [(s, round(a * 10), round(e * 10)) for s, a, e in rows(found, "session_id", "start", "end")]
    assert got == sorted((k, a, e) for k, v in probs.items() for a, e in quiet_by_frame(v))


def test_scans_equal_plain_windows(spark):
    rng = random.Random(3)
    data = [(k, t, rng.choice([None, rng.randint(0, 9)])) for k in ("hot", "cold") for t in range(80 if k == "hot" else 5)]
    df = spark.createDataFrame(data, "k string, t long, v long")
    got = prefix_scan(
        df, ["k"], F.floor(F.col("t") / 7), ["t"],
        {
            "s": Scan("sum", F.col("v")),
            "m": Scan("max", F.col("v"), inclusive=False),
            "l": Scan("last", F.col("v"), inclusive=False),
        },
    )
    seen = {}
    want = []
    for k, t, v in data:
        past = seen.setdefault(k, [])
        known = [x for x in past if x is not None]
        want.append((k, t, sum(known) + (v or 0), max(known, default=None), known[-1] if known else None))
        past.append(v)
    assert sorted((r.k, r.t, r.s, r.m, r.l) for r in got.collect()) == sorted(want)


def test_union_and_turns_against_brute_force(spark):
    rng = random.Random(11)
    data = []
    for case in ("a", "b"):
        for _ in range(60):
            s = rng.randint(0, 400)
            data.append((case, rng.choice("xy"), float(s), float(s + rng.choice([1, 2, 3, 120]))))
    df = spark.createDataFrame(data, "session_id string, speaker string, start double, end double")
    got = rows(iv.union_intervals(df, ["session_id", "speaker"], chunk_s=10.0), "session_id", "speaker", "start", "end")
    want = []
    for case in ("a", "b"):
        for sp in "xy":
            out = []
            for s, e in sorted((s, e) for c, p, s, e in data if (c, p) == (case, sp)):
                if out and s <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            want += [(case, sp, s, e) for s, e in out]
    assert got == sorted(want)

    turns = rows(iv.turns(df, chunk_s=10.0), "session_id", "start", "end", "speaker")
    want = []
    for case in ("a", "b"):
        out = []
        for s, e, sp in sorted((s, e, p) for c, p, s, e in data if c == case):
            if out and out[-1][3] == sp and s - out[-1][2] <= 1.0:
                out[-1][2] = max(out[-1][2], e)
            else:
                out.append([case, s, e, sp])
        want += [tuple(x) for x in out]
    assert turns == sorted(want)


def test_turns_hand_case(spark):
    data = [("USER", 0.0, 2.0), ("USER", 2.3, 4.0), ("USER", 6.0, 8.0), ("S1", 8.0, 9.0), (None, 9.0, 10.0), ("S1", 11.0, 11.0)]
    df = spark.createDataFrame([("a", *r) for r in data], "session_id string, speaker string, start double, end double")
    assert rows(iv.turns(df), "start", "end", "speaker") == [(0.0, 4.0, "USER"), (6.0, 8.0, "USER"), (8.0, 9.0, "S1")]


def test_one_long_interval_joins_many_chunks(spark):
    data = [("a", 0.0, 1000.0)] + [("a", float(t), float(t + 1)) for t in range(5, 900, 5)]
    df = spark.createDataFrame(data, "k string, start double, end double")
    ids = interval_islands(df, ["k"], iv.time_chunk("start", 10.0), "start", "end", lambda gap: gap > 0)
    assert {r.island for r in ids.collect()} == {1}


def test_island_ids_across_chunks(spark):
    df = spark.createDataFrame([("a", i, i // 10) for i in range(50)], "k string, i long, v long")
    got = island_ids(df, ["k"], F.floor(F.col("i") / 7), ["i"], ["v"], lambda p, c: p["v"] != c["v"])
    assert all(r.island == r.v + 1 for r in got.collect())


def test_silence_log(spark, tmp_path):
    lines_ = ["silence_end: 3.5", "silence_start: 12", "size= 17kB time=00:01", "silence_end: 19.75 | silence_duration: 7.75", "silence_start: 600.125"]
    lines_ += ["  Duration: 01:00:05.25, start: 0", "silence_start: 700", "silence_end: 3605.25 | tail", "[x @ 0x1] silence_start: 3605.25"]
    (tmp_path / "b.log").write_text("\n".join(lines_))
    lines = capture.silence_logs(spark, str(tmp_path))
    found = rows(capture.paired_silences(lines), "start", "end")
    assert (12.0, 19.75) in found and found[-1][1] == 3605.25 and all(a < b for a, b in found) and 3.5 not in {b for _, b in found}
    assert [r.duration_s for r in capture.logged_durations(lines).collect()] == [3605.25]


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.WAV").write_bytes(b"abc")
    (tmp_path / "empty.ogg").write_bytes(b"")
    (tmp_path / "plain").write_bytes(b"x")
    good, bad = capture.accepted(capture.landed(spark, str(tmp_path)))
    assert sorted((r.codec, r.bytes_written, r.status) for r in good.collect()) == [("bin", 1, "pending_vad"), ("wav", 3, "pending_vad")]
    # Spark's file scan leaves empty files out, so one never becomes a session; a listing that
    # holds them gets them back as rejects.
    assert bad.count() == 0
    listing = spark.sql("SELECT '/x/e.ogg' AS path, 0L AS length, now() AS modificationTime UNION ALL SELECT '/x/big.ogg', 524288001L, now()")
    none, rejects = capture.accepted(listing)
    assert none.count() == 0
    assert sorted(r.reason for r in rejects.collect()) == ["empty", "too large"]


def test_child_sessions(spark):
    sessions = spark.sql(
        "SELECT * FROM VALUES ('p', 'u', TIMESTAMP '2024-01-01 00:00:00', 'pending_vad'), ('q', 'u', TIMESTAMP '2024-01-01 00:00:00', 'pending_vad') AS t(id, user_id, started_at, status)"
    )
    cuts = spark.createDataFrame([("p", 0, 10.0, 70.5)], "session_id string, idx long, start double, end double")
    children, parents = seg.child_sessions(sessions, cuts)
    child = children.withColumn("s", F.date_format("started_at", "HH:mm:ss")).first()
    assert (child.id, child.parent_id, child.s, child.duration_s, child.status) == ("p-0", "p", "00:00:10", 60.5, "pending_stt")
    assert sorted((r.id, r.status) for r in parents.collect()) == [("p", "segmented"), ("q", "silent")]


def plain_runs(probs, threshold, low, bridge_s, frame_s):
    """Hysteresis and bridging of ``{frame: probability}``, frame by frame."""
    state, found = 0, []
    for number in sorted(probs):
        p = probs[number]
        state = 1 if p is not None and p >= threshold else 0 if p is None or p < low else state
        if state:
            if found and number - found[-1][1] <= 1:
                found[-1][1] = number
            else:
                found.append([number, number])
    out = []
    for a, b in found:
        start, end = a * frame_s, (b + 1) * frame_s
        if out and start - out[-1][1] < max(bridge_s, frame_s / 2):
            out[-1][1] = end
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def test_chunks_join_under_several_settings(spark):
    rng = random.Random(12)
    sessions = {}
    for name in "abcdef":
        p = {n: rng.choice([0.9, 0.45, 0.45, 0.45, 0.1]) for n in range(rng.choice([1, 40, 400])) if rng.random() > 0.03}
        sessions[name] = p or {0: 0.9}
    sessions["all"] = dict.fromkeys(range(100), 0.9)
    sessions["undecided"] = dict.fromkeys(range(50), 0.45)
    df = spark.createDataFrame([(s, n, v) for s, p in sessions.items() for n, v in p.items()], "session_id string, frame_idx long, prob double").repartition(4)
    settings = [(0.5, 0.35, 0.0), (0.5, 0.35, 1.0), (0.5, 0.35, 40.0), (0.8, 0.5, 2.5), (0.95, 0.5, 1.0)]
    for chunk in (3, 16, 1000):
        folded = seg.folded_frames(df, settings, 0.5, chunk)
        got = {}
        for r in seg._joined_runs(folded, [x[2] for x in settings], 0.5).collect():
            got.setdefault((r.setting, r.session_id), []).append((r.start, r.end))
        want = {(n, s): plain_runs(p, *setting, 0.5) for n, setting in enumerate(settings) for s, p in sessions.items()}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}, chunk


def test_sweep_equals_single_runs(spark):
    rng = random.Random(13)
    frames_ = [(s, n, rng.choice([0.9, 0.9, 0.45, 0.1, 0.1])) for s in range(4) for n in range(300)]
    df = spark.createDataFrame(frames_, "session_id long, frame_idx long, prob double")
    durations = spark.createDataFrame([(s, 150.0) for s in range(4)] + [(9, 20.0), (10, 0.0)], "session_id long, duration_s double")
    names = ("threshold", "min_speech_s", "min_silence_s", "gap_s", "pad_s")
    settings = [dict(zip(names, x)) for x in ((0.5, 1.0, 1.0, 2.0, 0.0), (0.5, 0.5, 2.0, 3.0, 0.25), (0.7, 9.0, 1.0, 2.0, 0.5), (0.01, 0.0, 0.5, 1e9, 0.0), (0.5, 1.0, 0.0, 1.0, 0.0))]
    rows = seg.parameter_sweep(df, durations, settings, 0.5).collect()
    assert len(rows) == len(settings) * 6
    got = {(r.setting, r.session_id): (r.n_conversations, round(r.speech_s, 6)) for r in rows}
    for n, x in enumerate(settings):
        silences = seg.silences_from_frames(df, durations, 0.5, max(x["threshold"], 0.05), None, min(x["min_speech_s"], 5.0), x["min_silence_s"])
        kept = {}
        for r in seg.conversations_from_silences(durations, silences, x["gap_s"], x["pad_s"]).collect():
            count, length = kept.get(r.session_id, (0, 0.0))
            kept[r.session_id] = (count + 1, length + r.end - r.start)
        for s in (0, 1, 2, 3, 9, 10):
            count, length = kept.get(s, (0, 0.0))
            assert got[n, s] == (count, round(length, 6)), (n, s)
