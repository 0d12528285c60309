"""Transcripts, speakers, triggers, extraction, calendar, files, streams: hand cases."""

import json
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import ical
from parlance.functions.answers import first_object, mended
from parlance.functions.text import phrase_list, shell_quoted, without_fences, without_thinking
from parlance.functions.vectors import cosine
from parlance.operators.phrases import sweep
from parlance.operators.vectors import nearest, similar_pairs, similarity_components
from parlance.plans import archive as ar
from parlance.plans import daily as dy
from parlance.plans import extraction as ex
from parlance.plans import speakers as sp
from parlance.plans import transcripts as tr
from parlance.plans import triggers as tg
from parlance.session import shared_path
from parlance.sources import calendar as ics
from parlance.sources import evalfiles, tables
from parlance.streaming import live
from parlance.streaming import rollover as ro

SEG = "session_id string, pos int, start double, end double, text string, speaker string, speaker_id string"


def segments(spark, *rows):
    return spark.createDataFrame([("a", i, *(list(r) + [None] * (5 - len(r)))) for i, r in enumerate(rows)], SEG)


def one(spark, sql_value, fn):
    return spark.sql(f"SELECT {sql_value} AS x").select(fn(F.col("x"))).first()[0]


def test_collapse(spark):
    texts = ["ok.", " OK.", "Ok. ", "ok.", "then", "then", "", "", "", "so", "and so", "And so", "and so"]
    rows = [(float(i), i + 0.5, t) for i, t in enumerate(texts)]
    got = tr.collapse_repeats(segments(spark, *rows)).orderBy("pos").collect()
    want = [("ok. (×4)", 0.0, 3.5), ("then", 4.0, 4.5), ("then", 5.0, 5.5)] + [("", i, i + 0.5) for i in (6.0, 7.0, 8.0)] + [("so", 9.0, 9.5), ("and so (×3)", 10.0, 12.5)]
    assert [(" ".join(r.text.split()), r.start, r.end) for r in got] == want
    again = tr.collapse_repeats(spark.createDataFrame(got, SEG)).orderBy("pos").collect()
    assert again == got


def test_relabel_and_ties(spark):
    rows = [(0.0, 2.0, "x", "P"), (2.0, 4.0, "x", "Q"), (4.0, 9.0, "x", "R"), (9.0, 9.0, "x", "Z"), (9.0, 9.5, "x", None)]
    got = tr.relabel_by_talk_time(segments(spark, *rows)).orderBy("pos").collect()
    assert [r.speaker for r in got] == ["S1", "S2", "USER", "Z", None]


def test_overlap_labels(spark):
    from parlance.operators.overlap import label_by_overlap

    segs = segments(spark, (0.0, 10.0, "x", "old"), (10.0, 14.0, "x", "old"), (50.0, 51.0, "x", "old"), (3.0, 3.0, "x", "old"))
    turns = spark.createDataFrame([("a", 0.0, 5.0, "A"), ("a", 5.0, 12.0, "B"), ("a", 12.0, 200.0, "C")], "session_id string, start double, end double, speaker string")
    got = label_by_overlap(segs, turns, bucket_s=4.0).orderBy("pos").collect()
    assert [r.speaker for r in got] == ["A", "B", "C", "old"]


def test_promotion(spark):
    segs = segments(spark, (0.0, 5.0, "x", "USER", "s1"), (5.0, 7.0, "x", "S1", "s2"), (7.0, 8.0, "x", "S2", None))
    speakers = spark.createDataFrame([("s2", True), ("s1", False)], "id string, is_user boolean")
    got = tr.promote_known_wearer(segs, speakers).orderBy("pos").collect()
    assert [r.speaker for r in got] == ["S1", "USER", "S2"]


def test_rendering_budget(spark):
    rows = [(float(i), float(i + 1), "word " * 10, "S1") for i in range(50)]
    got = tr.rendered(segments(spark, *rows), budget=500).first()
    lines = got.body.split("\n")
    assert lines[0] == "[00:00] [S1] " + ("word " * 10).strip()
    assert lines[-1] == "... (truncated)" and sum(len(x) + 1 for x in lines[:-1]) <= 500 and got.n_lines == len(lines) - 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "g string, id string, embedding array<double>")


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    q = [("g", f"q{i:03d}", rng.normal(size=6).tolist()) for i in range(60)]
    c = [("g", f"c{i:03d}", rng.normal(size=6).tolist()) for i in range(40)] + [("g", "short", [1.0]), ("g", "zero", [0.0] * 6)]
    got = nearest(vectors(spark, q), vectors(spark, c).withColumnRenamed("id", "cid"), "g", "id", "cid", threshold=0.5, block=7)
    found = {r.id: (r.cid, round(r.similarity, 9)) for r in got.collect()}
    want = {}
    for _, i, a in q:
        best = (0.5, None)
        for _, j, b in c:
            if len(a) == len(b) and any(b):
                s = float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
                if s > best[0]:
                    best = (s, j)
        if best[1]:
            want[i] = (best[1], round(best[0], 9))
    assert found == want


def test_components_of_a_chain_over_many_blocks(spark):
    # Neighbours on an arc are similar, the ends are not: one chain, one loner.
    rows = [("g", f"n{i:02d}", [float(np.cos(i / 10)), float(np.sin(i / 10))]) for i in range(25)]
    rows.append(("g", "zz", [0.0, -1.0]))
    df = vectors(spark, rows)
    parts = {r.id: r.survivor for r in similarity_components(df, "g", "id", threshold=0.994, block=3).collect()}
    assert parts == {**{f"n{i:02d}": "n00" for i in range(25)}, "zz": "zz"}
    pairs = {(r.a, r.b) for r in similar_pairs(df, "g", "id", threshold=0.994, block=3).collect()}
    assert pairs == {(f"n{i:02d}", f"n{i + 1:02d}") for i in range(24)}


def test_cluster_merge_switch(spark):
    turns = spark.createDataFrame([("a", "S1")], "session_id string, speaker string")
    assert sp.merge_clusters(turns, turns, 1.0) is turns


def test_ordered_linking(spark):
    rows = [
        ("u", 1, "c1", "USER", [1.0, 0.0]), ("u", 2, "c2", "S1", [0.0, 1.0]), ("u", 3, "c3", "S1", [0.9, 0.1]),
        ("u", 4, "c4", "S1", [0.0, 0.0]), ("v", 1, "d1", "S1", [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "user_id string, ord int, cluster_id string, label string, embedding array<double>")
    links = sp.link_ordered(df)
    got = {r.cluster_id: (r.speaker_id, r.is_new, r.mention_count, r.is_user) for r in links.collect()}
    assert got == {
        "c1": ("c1", True, 1, True), "c2": ("c2", True, 1, False), "c3": ("c1", False, 2, True), "d1": ("d1", True, 1, False),
    }
    after = {r.speaker_id: r.embedding for r in sp.registry_after(links).collect()}
    assert after["c1"] == pytest.approx([0.95, 0.05])


def test_cosine(spark):
    value = lambda a, b: spark.sql(f"SELECT array({a}) AS a, array({b}) AS b").select(cosine(F.col("a"), F.col("b"))).first()[0]
    assert value("1D, 0D", "1D, 1D") == pytest.approx(2**-0.5)
    assert value("1D, 0D", "0D, 0D") == 0.0 and value("1D", "1D, 0D") == 0.0


def slow_slices(text, phrases, stops):
    """Every place of every phrase by comparison, then accepted from the left."""
    low, places = text.lower(), []
    for phrase in phrases:
        key, at = phrase.lower().strip(), 0
        while key and at + len(key) <= len(low):
            hit = low[at : at + len(key)] == key
            places += [(at, at + len(key), phrase)] if hit else []
            at += len(key) if hit else 1
    taken = []
    for place in sorted(places):
        if not taken or place[0] >= taken[-1][1]:
            taken.append(place)
    out = []
    for i, (begin, end, phrase) in enumerate(taken):
        borders = [taken[i + 1][0] if i + 1 < len(taken) else len(text)]
        borders += [low.find(s.lower(), end) for s in stops if low.find(s.lower(), end) >= 0]
        out.append((phrase, begin, end, text[begin : min(borders)].strip()))
    return out


def test_phrase_sweep_equals_comparison():
    rng = random.Random(8)
    piece = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(3000):
        text = piece("xyX ", rng.randrange(30))
        phrases = sorted({piece("xy", rng.randrange(1, 4)) for _ in range(3)})
        stops = [piece("xy", 2)]
        assert sweep(tuple(phrases), tuple(stops)).slices(text) == slow_slices(text, phrases, stops)
    assert sweep((" ", ""), ()).slices("any text") == []


def test_each_action_meets_its_own_user(spark):
    actions = spark.createDataFrame(
        [(1, "u", ["note"], ["end"], "a", True), (2, "u", ["NOTE this", "done"], [], "b", True), (3, "u", ["note"], [], "c", False), (4, "w", ["note"], None, "d", True)],
        "id int, user_id string, phrases array<string>, stop_phrases array<string>, command string, enabled boolean",
    )
    texts = spark.createDataFrame([("u", 10, "Note this down end done"), ("w", 11, "nothing"), ("w", 12, None), ("v", 13, "note")], "user_id string, conversation_id int, text string")
    got = sorted((r.wake_action_id, r.conversation_id, r.nth, r.transcript) for r in tg.matched(texts, actions).collect())
    assert got == [(1, 10, 0, "Note this down"), (2, 10, 0, "Note this down end"), (2, 10, 1, "done")]


def test_commands(spark):
    df = spark.createDataFrame([("say $a ${b} $c $$x $", "it's", "plain")], "t string, a string, b string")
    got = df.select(tg.resolved(F.col("t"), {"a": F.col("a"), "b": F.col("b")})).first()[0]
    assert got == "say 'it'\"'\"'s' plain $c $x $"
    assert one(spark, "''", shell_quoted) == "''"
    assert one(spark, "'a,\\n b\\r\\n,'", phrase_list) == ["a", "b"]


def test_actions_with_bad_lists(spark):
    df = spark.createDataFrame(
        [(1, '["a"]', None), (2, "nope", None), (3, '["b"]', "[[")], "id int, phrases_json string, stop_phrases_json string"
    )
    got = {r.id: (r.phrases, r.stop_phrases) for r in tg.decoded_actions(df).collect()}
    assert got == {1: (["a"], []), 3: (["b"], [])}


def test_answers(spark):
    assert one(spark, "'<think>a</think><think>b</think> {}'", without_thinking).strip() == "{}"
    assert one(spark, "'x <think> never'", without_thinking) == "x "
    assert one(spark, "'```json\\n{}\\n```'", without_fences) == "{}"
    assert one(spark, "'``` only'", without_fences) == "``` only"
    assert first_object('so {"a": "}", "b": {"c": 1}} {"d": 2}') == '{"a": "}", "b": {"c": 1}}'
    assert json.loads(mended('{"a": [1, 2, {"b": "cut of')) == {"a": [1, 2, {"b": "cut of"}]}
    assert json.loads(mended('{"a": 1, "b')) == {"a": 1}
    assert json.loads(mended('{"a": "x", "b": ')) == {"a": "x"}
    assert mended("{'a': 1") is None and mended('{"a":"x" "b":"y"}') is None
    damaged = '{"title": "kept", "topics": ["p"], "score": 0.9 , "x": [1, 2, fal, 3, 4'
    assert json.loads(mended(damaged)) == {"title": "kept", "topics": ["p"], "score": 0.9, "x": [1, 2]}


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"title":"a","summary":"b" "topics":["x"],"events":[{"t":1} {"t":2}]}', {"title": "a", "summary": "b", "topics": ["x"], "events": [{"t": 1}, {"t": 2}]}),
        ('{title: "a", "score": fal, "b": [1 2,], "c": True,, "d": , "e": 3}', {"title": "a", "score": None, "b": [1, 2], "c": True, "d": None, "e": 3}),
        ('{"a": "x\ny\\d \\\'", "b": [1, {"c": 2}, "d": 3}', None),
        ('{"a": "x\ny\\d \\\'", "b": {"c": [1, 2}, "d": 3}', {"a": "x\ny\\d '", "b": {"c": [1, 2]}, "d": 3}),
        ('{"a": 1 "b": nul, "c": [{"d": "cut \\u00', {"a": 1, "b": None, "c": [{"d": "cut "}]}),
        ('{"a": 1 "b": 2, "c": tr', {"a": 1, "b": 2}),
        ('{"a": 1, "b": "he said "no" to me", "c": 2}', {"a": 1, "b": 'he said "no" to me', "c": 2}),
        ('{"a": 1, "b": ["he said "no" to me", "x"], "c": 2}', {"a": 1, "b": ['he said "no" to me', "x"], "c": 2}),
        ("{\"a\": 1, 'b': 2}", {"a": 1, "b": 2}), ('{"a": 1, "b": not sure, "c": 2}', {"a": 1, "b": "not sure", "c": 2}), ('{"a": 1, "b" 2}', None), ("{,}", None),
        ("{'a': 'it\\'s', 'b': ['x', 'say \"hi\"'], 'c': {'d': None}}", {"a": "it's", "b": ["x", 'say "hi"'], "c": {"d": None}}),
        ("{'a': 'it's late, isn't it', 'b': 'the end'}", {"a": "it's late, isn't it", "b": "the end"}),
        ("{\u201ca\u201d: \u201cone, two\u201d, \u201cb\u201d: [\u2018x\u2019, \u201ey\u201c]}", {"a": "one, two", "b": ["x", "y"]}),
        ('{"a": "plain \u201cquoted\u201d, here", "b": .5, "c": +1, "d": -.25e2, "e": 3., "f": NaN, }', {"a": "plain \u201cquoted\u201d, here", "b": 0.5, "c": 1, "d": -25.0, "e": 3, "f": None}),
        ('{ // first\n "a": "http://x/y", /* two\n lines */ "b": [1, /* no */ 2], // c\n "c": "/* kept */" } and then {more}', {"a": "http://x/y", "b": [1, 2], "c": "/* kept */"}),
        ('{"a": call Ann tomorrow, "b": [one thing, "two", 3], "c": 2024-05-01}', {"a": "call Ann tomorrow", "b": ["one thing", "two", 3], "c": "2024-05-01"}),
        ('{"a": call Ann, then Bob, "b": "x"}', {"a": "call Ann, then Bob", "b": "x"}),
        ('{"title": "a "b", c", "items": [{"t": "say "x"", "n": 1}, {"t": "y"}]}', {"title": 'a "b", c', "items": [{"t": 'say "x"', "n": 1}, {"t": "y"}]}),
        ("{'a': 'x', 'b': 'cut in the mid", {"a": "x", "b": "cut in the mid"}),
        ('{"a": "x", // cut\n "b": [{"c": \u201cyes\u201d}, {"c": \u201cn', {"a": "x", "b": [{"c": "yes"}, {"c": "n"}]}),
    ],
)
def test_faults_are_mended_where_they_are(raw, want):
    from parlance.functions.answers import _recovered

    text, repaired = _recovered(raw)
    assert (text and json.loads(text), repaired) == (want, want is not None)


def test_one_bad_answer_ends_nothing(spark):
    raw = ['{"title": "a", "quality_score": NaN}', '{"title": "b", "title": "c"}', "{'title' 'd'}", '{"title": "e"}', None, "{'title': 'd'}"]
    df = spark.createDataFrame([(str(i), "u", r) for i, r in enumerate(raw)], "session_id string, user_id string, raw string").withColumns(
        {"started_at": F.lit("2024-01-01 00:00:00").cast("timestamp"), "ended_at": F.lit(None).cast("timestamp")}
    )
    out = ex.ingested(df)
    assert {r.id: (r.title, r.quality_score) for r in out["conversations"].collect()} == {"0": ("a", 0.5), "1": ("c", 0.5), "3": ("e", 0.5), "5": ("d", 0.4)}
    assert sorted(r.session_id for r in out["failed"].collect()) == ["2", "4"]


def test_repeated_changes_leave_one_row(spark):
    from parlance.operators.rows import updated

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(1, "x", 5), (1, "y", 9), (1, "z", 7), (3, "w", 1)], "id int, v string, changed_at int")
    assert sorted(map(tuple, updated(rows, changes, "id", ["v"]).collect())) == [(1, "y"), (2, "b")]
    assert sorted(map(tuple, updated(rows, changes.drop("changed_at"), "id", ["v"]).collect())) == [(1, "z"), (2, "b")]


def test_new_speakers_never_meet_known_ones(spark):
    clusters = spark.createDataFrame(
        [("u", 1, [1.0, 0.0]), ("u", 2, [0.0, 1.0]), ("u", 3, [0.05, 1.0]), ("u", 4, [1.0, 0.0, 0.0]), ("u", 5, None)], "user_id string, cluster_id long, embedding array<double>"
    )
    speakers = spark.createDataFrame([("u", 2, [1.0, 0.1], 4)], "user_id string, id long, embedding array<double>, mention_count long")
    got = {r.cluster_id: (r.speaker_id, r.is_new) for r in sp.link_frozen(clusters, speakers).collect()}
    assert got == {1: (2, False), 2: (-3, True), 3: (-3, True), 4: (-5, True)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-01-01T10", "2024-01-01 10:00"), ("20240101T103000Z", "2024-01-01 10:30"), ("2024-W01-3", "2024-01-03 00:00"), ("2024W011", "2024-01-01 00:00"),
        ("2024-05-02 08:15:30.5+02:00", "2024-05-02 06:15"), ("2024-05-02T08:15-0130", "2024-05-02 09:45"), ("2024-13-01", ""), ("2024-02-30", ""), ("soon", ""), ("2024-W60-1", ""),
    ],
)
def test_iso_times(spark, text, want):
    from parlance.functions.values import iso_timestamp, shown_time

    assert one(spark, f"'{text}'", lambda x: shown_time(iso_timestamp(x))) == want


def test_extraction(spark):
    raw = [
        ("ok", '{"title": " T ", "topics": ["x", 3], "quality_score": "1.7", "calendar_events": [{"title": "", "confidence": "high"}, 5],'
               ' "action_items": [{"text": " do "}, {"text": " "}], "people_mentioned": [{"name": "Ann"}]}'),
        ("cut", '{"title": "T2", "quality_score": 0.05, "decisions": [{"text": "go", "confidence": 0.9'),
        ("bad", "no json here"),
        ("thinking", '<think>{"title": "draft"}'),
    ]
    df = spark.createDataFrame([(i, "u", r) for i, r in raw], "session_id string, user_id string, raw string").withColumns(
        {"started_at": F.lit("2024-01-01 00:00:00").cast("timestamp"), "ended_at": F.lit(None).cast("timestamp")}
    )
    out = {k: v.collect() for k, v in ex.ingested(df).items()}
    conv = {r.id: r for r in out["conversations"]}
    assert (conv["ok"].title, conv["ok"].topics, conv["ok"].quality_score) == ("T", ["x"], 1.0)
    assert (conv["cut"].extraction_repaired, conv["cut"].quality_score) == (True, 0.0)
    assert [(r.title, r.confidence) for r in out["calendar_events"]] == [("(untitled)", 0.5)]
    assert [r.text for r in out["action_items"]] == ["do"]
    assert [(r.text, r.confidence) for r in out["decisions"]] == [("go", 0.9)]
    assert sorted(r.session_id for r in out["failed"]) == ["bad", "thinking"]


def test_model_hook(spark):
    def double(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "twice": b["id"] * 2})

    got = ex.through_model(spark.range(5), double, "id long, twice long", tasks=3)
    assert sorted((r.id, r.twice) for r in got.collect()) == [(i, 2 * i) for i in range(5)]


def test_calendar_folding(spark):
    rng = random.Random(4)
    for _ in range(50):
        line = "".join(rng.choice("aé漢😀 ") for _ in range(rng.randint(0, 200)))
        folded = ical._fold_one(line)
        assert folded.replace("\r\n ", "") == line
        assert all(len(part.encode()) <= 75 for part in folded.split("\r\n"))
    assert one(spark, "'a;b,c\\\\d\\r\\ne'", ical.escaped) == "a\\;b\\,c\\\\d\\ne"


def test_calendar_file(spark, tmp_path):
    events = spark.sql(
        """SELECT * FROM VALUES (1, 'Tea: now!', NULL, TIMESTAMP '2024-03-01 10:00:00', NULL, NULL, 0.625D, 7, 'Chat'),
        (2, 'later', 'd', TIMESTAMP '2024-02-01 10:00:00', TIMESTAMP '2024-02-01 12:00:00', 'x', 0.9D, 7, ''), (3, 'none', NULL, NULL, NULL, NULL, 0.9D, 7, NULL)
        AS t(id, title, description, starts_at, ends_at, location, confidence, conversation_id, conversation_title)"""
    )
    ics.write_feed(ics.feed(events, "2024-01-01 00:00:00"), str(tmp_path / "feed"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "feed").glob("part-*")))
    lines = text.split("\r\n")
    assert lines[0] == "BEGIN:VCALENDAR" and lines[-2:] == ["END:VCALENDAR", ""]
    assert [x for x in lines if x.startswith("DTEND")] == ["DTEND:20240201T120000Z", "DTEND:20240301T110000Z"]
    assert "DESCRIPTION:confidence: 62%\\nfrom: Chat\\nconversation: 7" in lines
    single = {r.id: r.file_name for r in ics.single_event(events, "2024-01-01 00:00:00").collect()}
    assert single == {1: "Tea_now-1.ics", 2: "later-2.ics"}


def test_case_files(spark, tmp_path):
    for name, files in {
        "good": {"reference.txt": "oui", "audio.wav": "x", "reference_turns.json": '[{"start": 0, "end": 1, "speaker": "A"}]', "case.json": '{"verified": true}'},
        "odd": {"reference.txt": "non", "audio.ogg": "x", "reference_turns.json": "[oops"},
        "blank": {"reference.txt": " \n", "audio.wav": "x"},
        "silent": {"reference.txt": "text"},
    }.items():
        (tmp_path / name).mkdir()
        for file, text in files.items():
            (tmp_path / name / file).write_text(text)
    got = {r.case: (r.verified, None if r.turns is None else len(r.turns)) for r in evalfiles.load_cases(spark, str(tmp_path)).collect()}
    assert got == {"good": (True, 1), "odd": (False, None)}


def test_reference_writer(spark, tmp_path):
    rows = spark.createDataFrame(
        [("c", 2.0, 1, 3.0, "S1", "two"), ("c", 0.0, 0, 1.0, "USER", "one"), ("d", 0.0, 0, 1.0, None, "x")],
        "case string, start double, pos int, end double, speaker string, text string",
    )
    evalfiles.write_reference(rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out/reference/case=c").glob("part-*")))
    assert text == "one\ntwo\n"
    back = evalfiles.read_reference(spark, str(tmp_path / "out")).select(*rows.columns)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    with pytest.raises(Exception, match="(?i)not exist|no such file"):
        evalfiles.load_cases(spark, str(tmp_path / "nowhere"))


def test_digest_files(spark, tmp_path):
    conv = spark.sql("SELECT 1 AS id, 'u' AS user_id, TIMESTAMP '2024-01-01 23:30:00' AS started_at, 'T' AS title, '' AS summary, 0.5D AS quality_score, NULL AS quality_override")
    events = spark.sql("SELECT 1 AS conversation_id, 5 AS id, 'tea' AS title, TIMESTAMP '2024-02-01 10:00:00' AS starts_at")
    actions = spark.sql("SELECT 1 AS conversation_id, 6 AS id, 'buy' AS text, 'ann' AS owner, 'open' AS status")
    people = spark.sql("SELECT 1 AS conversation_id, 7 AS id, 'Bob' AS name").limit(0)
    lines = dy.digest_lines(dy.eligible(conv, "Europe/Paris"), events, actions, people, "Europe/Paris")
    dy.write_digests(lines, str(tmp_path / "d"), tasks=2)
    text = "".join(p.read_text() for p in sorted((tmp_path / "d/user_id=u/day=2024-01-02").glob("part-*")))
    assert text.splitlines() == ["[00:30] T: (no summary)", "  events:", "    - tea 2024-02-01 10:00", "  open action items:", "    - buy (ann)"]


def test_day_at_clock_change(spark):
    from parlance.functions.values import day_bounds

    start, end = day_bounds(F.lit("2024-03-31").cast("date"), "Europe/Paris")
    assert spark.range(1).select((F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600).first()[0] == 23


def test_broken_segments_decode_to_nothing(spark):
    df = spark.createDataFrame([("[{\"start\": 1, \"text\": \"a\"}]",), ("{bad",), (None,)], "raw string")
    assert [len(r.s) for r in df.select(tables.decode_segments(F.col("raw")).alias("s")).collect()] == [1, 0, 0]


def test_evolution_is_idempotent(spark):
    old = spark.createDataFrame([("1",)], "id string")
    once = tables.evolve(old, "speakers")
    assert once.first().mention_count == 1 and once.first().is_user is False
    assert tables.evolve(once, "speakers").collect() == once.collect()
    assert once.schema == schemas.schema("speakers") or [f.name for f in once.schema] == [f.name for f in schemas.schema("speakers")]


def test_people_cap(spark):
    conv = spark.sql("SELECT 1 AS id, 'u' AS user_id, 'T' AS title")
    mentions = spark.sql("SELECT id, 1 AS conversation_id, CASE WHEN id < 3 THEN 'Ann' ELSE ' ann' END AS name, 'c' AS context, timestamp_seconds(id) AS mentioned_at FROM range(5)")
    assert [(r.mention_count, r.name) for r in ar.people(mentions, conv).collect()] == [(5, " ann")]
    assert [r.mention_count for r in ar.people(mentions, conv, recent_rows=3).collect()] == [3]


def test_rollover_equals_a_plain_fold(spark):
    rng = random.Random(9)
    data = []
    for c in ("x", "y"):
        t = 0
        for seq in range(200):
            t += rng.choice([1, 5, 30, 200])
            kind = rng.choices([ro.PACKET, ro.START, ro.STOP], [8, 1, 1])[0]
            data.append((c, t, seq, kind, rng.randint(1, 9), rng.randint(1, 3) if kind == ro.START else None))
    df = spark.createDataFrame(data, "connection_id string, t long, seq int, kind string, bytes long, rate int").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r.connection_id, r.started_us, r.ended_us, r.n_packets, r.bytes, r.rate, r.closed_by) for r in ro.closed_segments(df, 100.0).collect())
    want = []
    for c in ("x", "y"):
        seg = ro.Segment()
        for k, t, _, kind, size, rate in data:
            if k == c:
                want += [(c, *row) for row in seg.feed(t * 1_000_000, kind, size, rate, 100_000_000)]
        if seg.n_packets:
            want.append((c, *seg.close(seg.due(100_000_000), "rollover")))
    assert got == sorted(want)
    assert all(r.closed_by == "stop" for r in ro.closed_segments(df, 0).collect())


def test_rollover_of_a_connection_without_a_pause(spark):
    rng = random.Random(4)
    data, t = [], 0
    for seq in range(4000):
        t += rng.choice([0, 1, 2, 9])
        kind = ro.PACKET if rng.random() < 0.97 else ro.START
        if 1500 < seq < 1600:
            kind = ro.START  # no packets for several chunks
        data.append(("x", t, seq, kind, rng.randint(1, 9), rng.randint(1, 3) if kind == ro.START else None))
    data.append(("x", t, 4000, ro.STOP, 0, None))
    df = spark.createDataFrame(data, "connection_id string, t long, seq int, kind string, bytes long, rate int").withColumn("ts", F.timestamp_seconds("t"))
    seg, want = ro.Segment(), []
    for _, t, _, kind, size, rate in data:
        want += [("x", *row) for row in seg.feed(t * 1_000_000, kind, size, rate, 20_000_000)]
    for chunk in (1, 3, 64):
        got = ro.closed_segments(df, 20.0, chunk_intervals=chunk).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert ro.closed_segments(df.limit(0), 20.0).collect() == []


def test_stage_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT id, CASE WHEN id % 2 = 0 THEN 'pending_stt' ELSE 'done' END AS status, CAST(NULL AS STRING) AS error_msg FROM range(10)").write.parquet(source)
    stream = spark.readStream.schema("id long, status string, error_msg string").parquet(source)
    work = lambda waiting: waiting.select("id", F.when(F.col("id") == 4, F.lit("boom")).alias("error_msg"))
    live.run_stage(stream, "stt", work, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {r.id: r.status for r in spark.read.parquet(str(tmp_path / "out")).filter("id % 2 = 0").collect()}
    assert got == {0: "pending_llm", 2: "pending_llm", 4: "failed", 6: "pending_llm", 8: "pending_llm"}
    assert [(r.id, r.error_msg) for r in spark.read.parquet(str(tmp_path / "out-dead")).collect()] == [(4, "boom")]


def test_shared_folder_is_the_sessions(spark):
    assert shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_steps_are_dropped(spark, tmp_path):
    import os

    from parlance.session import settle, steps

    with steps(spark):
        table = settle(spark.range(5), "mine")
        path = table.inputFiles()[0].removeprefix("file://")
        table.write.parquet(str(tmp_path / "result"))
        assert os.path.exists(path)
    assert not os.path.exists(path) and spark.read.parquet(str(tmp_path / "result")).count() == 5
    kept = settle(spark.range(3), "kept")
    assert kept.count() == 3


def test_messages_lose_nothing(spark):
    rows = segments(spark, *[(float(i), i + 1.0, f"line {i} " + "x" * 20, "USER") for i in range(40)])
    parts = tr.rendered_parts(rows, budget=200).orderBy("part").collect()
    assert "\n".join(r.body for r in parts) == tr.rendered(rows).first().body and len(parts) > 3
    assert all(len(r.body) < 200 + 50 for r in parts)
    sessions = spark.sql("SELECT 'a' AS session_id, TIMESTAMP '2024-01-01' AS started_at, '' AS text UNION ALL SELECT 'b', TIMESTAMP '2024-01-01', repeat('y', 450)")
    got = ex.messages(sessions, tr.rendered_parts(rows, 200), "s", budget=200).filter("role = 'user'").collect()
    assert sorted((r.session_id, r.part) for r in got) == [("a", p.part) for p in parts] + [("b", 0), ("b", 1), ("b", 2)]
    assert sum(r.content.count("y") for r in got if r.session_id == "b") == 450


def test_checksums_of_large_ids(spark):
    from parlance.catalog.changes import counted

    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    big = 2**62
    found = counted(
        {"in": frame(big, big - 1, None), "over": frame(big, big, 5), "under": frame(-big, -big, -1), "far": frame(*[2**63 - 1] * 5), "none": frame()}
    )
    assert {r["name"]: (r["n"], r["id_sum"]) for r in found.collect()} == {
        "in": (3, 2**63 - 1), "over": (3, 5 - 2**63), "under": (3, 2**63 - 1), "far": (5, 2**63 - 5), "none": (0, 0),
    }
    assert dict(found.dtypes) == {"n": "bigint", "id_sum": "bigint", "name": "string"}


def test_rollover_reads_groups_across_batches(spark):
    """Groups come in sorted runs of rows: none is cut where an Arrow batch ends, none costs a stream of its own."""
    def sizes(group):
        assert group["at"].to_pylist() == sorted(group["at"].to_pylist())
        return pa.table({"a": group["a"][:1], "b": group["b"][:1], "n": pa.array([group.num_rows])})

    rows = [(a, b, at) for a in "xy" for b in range(30) for at in range(b + 1)]
    random.Random(3).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ro._by_group(spark.createDataFrame(rows, "a string, b int, at int"), ["a", "b"], "at", sizes, "a string, b int, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == sorted((a, b, b + 1) for a in "xy" for b in range(30))
    assert ro._by_group(spark.createDataFrame([], "a string, b int, at int"), ["a", "b"], "at", sizes, "a string, b int, n long").collect() == []


def test_rollover_runs_no_stream_per_group(spark):
    df = spark.createDataFrame([("x", 5, 1, ro.PACKET, 4, None)], "connection_id string, t long, seq int, kind string, bytes long, rate int").withColumn("ts", F.timestamp_seconds("t"))
    plan = ro._opening(
        df.selectExpr("connection_id", "0L AS part", "0L AS chunk", "5000000L AS us", "1L AS n_packets", "4L AS bytes", "0L AS rate"), 10_000_000, 640_000_000
    )._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan


def test_batches_are_read_in_small_parts(spark):
    from parlance.functions import batches
    from parlance.functions.answers import _recovered, answer_object
    from parlance.operators.phrases import phrase_matches

    assert [p.to_pylist() for p in batches.slices(pa.array(range(5)), 2)] == [[0, 1], [2, 3], [4]] and list(batches.slices(pa.array([]))) == []
    raw = [None if i % 7 == 0 else f"so {{'n': {i}, 'text': 'the {i}'" + "}" * (i % 2) for i in range(3 * batches.ROWS + 5)]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string").coalesce(1)
    found, repaired = answer_object(F.col("raw"))
    got = [tuple(r) for r in df.select(found.alias("o"), F.coalesce(repaired, F.lit(False)).alias("r")).collect()]
    assert got == [_recovered(t) for t in raw]
    words = lambda *w: F.array(F.array(*[F.lit(x) for x in w]))
    hits = df.select("raw", phrase_matches(F.col("raw"), words("the", "so"), words("'}")).alias("m")).collect()
    assert [[tuple(m) for m in r.m] for r in hits] == [
        [] if t is None else [(0, n, *s[:1], *s[1:]) for n, s in enumerate(sweep(("the", "so"), ("'}",)).slices(t))] for t in raw
    ]
    plan = df.select(found.alias("o"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan
