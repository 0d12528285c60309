"""Case folders as a data source, upload checks, path guard, local days."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.functions import values as fv
from parlance.plans import archive as ar
from parlance.sources import capture, casefolders, evalfiles


def test_written_cases_are_loaded(spark, tmp_path):
    audio = tmp_path / "a.opus"
    audio.write_bytes(b"\x00\x01" * 700_000)
    kinds = "case string, pos int, start double, end double, speaker string, text string"
    turns = [("one", 1, 2.0, 3.0, "USER", " second é "), ("one", 0, 0.0, 1.5, None, "first \"quoted\""), ("one", 2, 9.0, 9.5, "B", "  "), ("two", 0, 0.0, 1.0, "B", "x"), ("none", 0, 0.0, 1.0, "B", "no facts")]
    facts = spark.createDataFrame([("one", str(audio), {"verified": "true", "notes": "n"}), ("two", str(audio), {}), ("empty", str(audio), {})], "case string, audio_path string, meta map<string,string>")
    folder = str(tmp_path / "cases")
    rows = spark.createDataFrame(turns, kinds).repartition(3)
    casefolders.write_cases(rows, facts, folder)
    assert sorted(p.name for p in (tmp_path / "cases").iterdir() if not p.name.startswith((".", "_"))) == ["empty", "one", "two"]
    assert (tmp_path / "cases/one/reference.txt").read_text() == 'first "quoted"\nsecond é'
    assert [t["speaker"] for t in json.loads((tmp_path / "cases/one/reference_turns.json").read_text())] == [None, "USER", "B"]
    assert (tmp_path / "cases/one/audio.opus").read_bytes() == audio.read_bytes()
    got = {r.case: r for r in evalfiles.load_cases(spark, folder).collect()}
    assert got.keys() == {"one", "two"}  # a blank reference is no case
    assert got["one"].verified and not got["two"].verified and got["one"].meta["notes"] == "n" and len(got["one"].turns) == 3
    with pytest.raises(Exception, match="there already"):
        casefolders.write_cases(rows, facts, folder)
    assert not [p for p in (tmp_path / "cases").iterdir() if p.name.startswith("_cases")]
    casefolders.write_cases(spark.createDataFrame([("two", 0, 0.0, 1.0, "B", "new")], kinds), facts.filter("case = 'two'"), folder, replace=True)
    again = {r.case: r.reference for r in evalfiles.load_cases(spark, folder).collect()}
    assert again["two"].strip() == "new" and "second" in again["one"]


def test_a_lost_audio_writes_nothing(spark, tmp_path):
    facts = spark.createDataFrame([("one", str(tmp_path / "gone.opus"), {})], "case string, audio_path string, meta map<string,string>")
    turns = spark.createDataFrame([("one", 0, 0.0, 1.0, "B", "x")], "case string, pos int, start double, end double, speaker string, text string")
    (tmp_path / "cases").mkdir()
    with pytest.raises(Exception):
        casefolders.write_cases(turns, facts, str(tmp_path / "cases"))
    assert list((tmp_path / "cases").iterdir()) == []


def test_empty_uploads_are_listed(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "e0.ogg").write_bytes(b"")
    (tmp_path / "in/e1.ogg").write_bytes(b"")
    (tmp_path / "in/deep/e2.wav").write_bytes(b"")
    (tmp_path / "in/.hidden").write_bytes(b"")
    (tmp_path / "in/full.ogg").write_bytes(b"abcd")
    files = capture.landed(spark, str(tmp_path)).unionByName(capture.empty_uploads(spark, str(tmp_path)))
    good, bad = capture.accepted(files, max_bytes=3)
    assert good.count() == 0
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in bad.collect()) == [("e0.ogg", "empty"), ("e1.ogg", "empty"), ("e2.wav", "empty"), ("full.ogg", "too large")]


def test_paths_and_days(spark):
    paths = {"/audio/x": True, "/audio/../x": False, "/audio/a/../../audio/b": True, "/audio": False, "/audio/": False, "//audio//y/.": True, "/audiox/y": False, "/../../audio/z": True}
    got = {r.p: r.ok for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", ar.below(F.col("p"), "/audio").alias("ok")).collect()}
    assert got == paths
    at = spark.sql("SELECT TIMESTAMP '2024-03-31 22:30:00' AS ts")
    day = fv.local_day(F.col("ts"), "Europe/Paris")
    row = at.select(day.cast("string"), *[x.cast("string") for x in fv.neighbour_days(day)], fv.local_day(F.col("ts"), "No/Zone").cast("string")).first()
    assert tuple(row) == ("2024-04-01", "2024-03-31", "2024-04-02", "2024-03-31")


def test_runs_keep_their_order(spark, tmp_path):
    folder = str(tmp_path / "history")
    row = lambda wer, *cases: spark.createDataFrame([(c, wer) for c in cases], "case string, wer double").repartition(3)
    numbers = [evalfiles.append_history(row(w, *cases), folder, ts, settings={"a": "b"} if w == 0.3 else None) for w, ts, cases in ((0.5, "2024-01-02", "xy"), (0.1, "2024-01-01", "xyz"), (0.3, "2024-01-02", "x"))]
    assert numbers == [0, 1, 2]
    got = {r.case: (r.ts, r.wer) for r in evalfiles.latest_metrics(spark, folder).collect()}
    assert got == {"x": ("2024-01-02", 0.3), "y": ("2024-01-02", 0.5), "z": ("2024-01-01", 0.1)}
    runs = evalfiles.recorded_runs(spark, folder).collect()
    assert [(r.run, r.settings, r.totals, len(r.fingerprint)) for r in runs] == [(2, {"a": "b"}, None, 16)]
    (tmp_path / "history/_runs/00000009").write_bytes(b"")  # another appender took a number
    assert evalfiles.append_history(row(0.9, "z"), folder, "2024-01-01") == 10
    assert {r.case: r.wer for r in evalfiles.latest_metrics(spark, folder).collect()}["z"] == 0.9


def test_cases_are_loaded_in_two_scans(spark, tmp_path):
    for name, files in {"a": ("reference.txt", "audio.ogg", "case.json"), "b": ("reference.txt",), "c": ("audio.ogg",), "d": ("reference.txt", "audio.ogg", "audio.mp3", "reference_turns.json")}.items():
        (tmp_path / name / "deep").mkdir(parents=True)
        for file in files:
            (tmp_path / name / file).write_text({"case.json": '{"verified": "true"}', "reference_turns.json": '[{"start": 1, "text": "x"}]'}.get(file, f"{name} é"))
        for file in ("reference.txt", "audio.ogg"):  # below a case, so no case
            (tmp_path / name / "deep" / file).write_text("no")
    cases = evalfiles.load_cases(spark, str(tmp_path))
    got = {r.case: (r.reference, r.audio_path.rsplit("/", 1)[1], r.verified, r.turns and len(r.turns)) for r in cases.collect()}
    assert got == {"a": ("a é", "audio.ogg", True, None), "d": ("d é", "audio.mp3", False, 1)}
    assert cases._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    (tmp_path / "none").mkdir()
    assert evalfiles.load_cases(spark, str(tmp_path / "none")).count() == 0


def test_reference_lines_are_written_without_a_hadoop_file_each(spark, tmp_path):
    kinds = "case string, pos long, start double, end double, speaker string, text string"
    turns = [("a", 1, 2.0, 3.0, "USER", "two é"), ("a", 0, 0.5, 1.0, None, "one"), ("b/=1", 0, 0.0, 1.0, "B", "x"), ("c", 0, 0.0, 1.0, "B", ""), (None, 0, None, None, "B", None)]
    rows, folder = spark.createDataFrame(turns, kinds), tmp_path / "out" / "cases"
    evalfiles.write_reference(rows, str(folder))
    assert sorted(map(tuple, evalfiles.read_reference(spark, str(folder)).collect()), key=str) == sorted(turns, key=str)
    texts = {p.name: "".join(f.read_text() for f in sorted(p.iterdir())) for p in (folder / "reference").iterdir()}
    assert texts == {"case=a": "one\ntwo é\n", "case=b%2F%3D1": "x\n"}
    assert [p for p in tmp_path.rglob("*") if p.name.endswith(".crc") or p.name.startswith("_cases")] == [] and {p.name for p in folder.iterdir()} == {"reference", "turns"}
    with pytest.raises(Exception, match="there already"):
        evalfiles.write_reference(rows, str(folder))
    evalfiles.write_reference(rows.limit(0), str(tmp_path / "empty"))
    assert evalfiles.read_reference(spark, str(tmp_path / "empty")).count() == 0


def test_lines_of_lost_attempts_are_left_out(tmp_path):
    writer = casefolders.CaseLinesWriter(str(tmp_path / "cases"))
    lost, kept = (writer.write(iter([{"case": "a", "line": said, "turn": "{}"}])) for said in ("lost", "kept"))
    writer.commit([kept])
    assert [p.read_text() for p in (tmp_path / "cases").rglob("*.txt")] == ["kept\n"] and lost.name != kept.name
    assert [p.name for p in tmp_path.iterdir()] == ["cases"]
