"""Evaluation cases and their history on shared storage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import fingerprint, string_or_null
from parlance.session import parallelism
from parlance.sources.casefolders import CaseLines

TURNS = "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, speaker: STRING, text: STRING>>"
METRICS = (
    "STRUCT<wer: DOUBLE, substitutions: LONG, insertions: LONG, deletions: LONG, ref_words: LONG,"
    " hyp_words: LONG, der: DOUBLE, miss_s: DOUBLE, false_alarm_s: DOUBLE, confusion_s: DOUBLE,"
    " ref_speech_s: DOUBLE, user_acc: DOUBLE, ref_user_s: DOUBLE, verified: BOOLEAN, error: STRING>"
)
TOTALS = "STRUCT<cases: LONG, failed: LONG, wer: DOUBLE, ref_words: LONG, der: DOUBLE, ref_speech_s: DOUBLE, user_acc: DOUBLE>"
RECORD = f"STRUCT<ts: STRING, run: LONG, note: STRING, settings: MAP<STRING, STRING>, fingerprint: STRING, totals: {TOTALS}, cases: MAP<STRING, {METRICS}>>"
_CASE, _NAME, _ROOT = r"([^/]+)/[^/]+$", r"([^/]+)$", r"/[^/]+/[^/]+$"


def _files(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """Files ``folder/<case>/name`` whose names fit: ``case, name, path, content``.

    Spark lists the folder once, its cases as tasks; a pattern over them would be resolved in the driver, one case after another.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.getFileStatus(place)  # a folder that is missing or closed to us is an error, not an empty suite
    root = files.makeQualified(place).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    own = found.filter(F.regexp_replace("path", _ROOT, "") == root)
    return own.select(F.regexp_extract("path", _CASE, 1).alias("case"), F.regexp_extract("path", _NAME, 1).alias("name"), "path", "content")


def load_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Complete cases: a non-blank reference text and an audio file.

    Unreadable turns or metadata count as absent.
    """
    whole = lambda name: F.max(F.when(F.col("name") == name, F.col("content").cast("string")))
    texts = _files(spark, folder, "{reference.txt,reference_turns.json,case.json}").groupBy("case").agg(
        whole("reference.txt").alias("reference"), whole("reference_turns.json").alias("turns"), whole("case.json").alias("meta")
    )
    audio = _files(spark, folder, "audio.*").groupBy("case").agg(F.min("path").alias("audio_path"))
    read = texts.withColumns({"turns": F.from_json("turns", TURNS), "meta": F.from_json("meta", "MAP<STRING, STRING>")})
    return (
        read.filter(string_or_null(F.col("reference")).isNotNull())
        .join(audio, "case")
        .select(
            "case", "audio_path", "reference", F.when(F.size("turns") > 0, F.col("turns")).alias("turns"),
            F.coalesce(F.try_element_at("meta", F.lit("verified")) == "true", F.lit(False)).alias("verified"), "meta",
        )
    )


def reference_lines(rows: DataFrame) -> DataFrame:
    """Text lines of the reference per case, in start order: ``case, start, pos, line``."""
    return rows.filter(string_or_null(F.col("text")).isNotNull()).select("case", "start", "pos", F.col("text").alias("line"))


def write_reference(rows: DataFrame, folder: str) -> None:
    """Write ``reference`` text and ``turns`` JSON lines, one folder per case, in start order; the folder must be new."""
    spark = rows.sparkSession
    spark.dataSource.register(CaseLines)
    order = ["case", "start", "pos"]
    line = F.when(string_or_null(F.col("text")).isNotNull(), F.col("text"))
    dealt = rows.repartitionByRange(parallelism(rows), *order).sortWithinPartitions(*order)
    turn = F.to_json(F.struct("pos", "start", "end", "speaker", "text"))
    dealt.select(F.col("case").cast("string").alias("case"), line.alias("line"), turn.alias("turn")).write.format(CaseLines.name()).mode("append").save(folder)


def read_reference(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_reference`` wrote: ``case, pos, start, end, speaker, text``, one row per turn."""
    turns = "pos LONG, start DOUBLE, end DOUBLE, speaker STRING, text STRING"
    return spark.read.schema(f"case STRING, {turns}").json(f"{folder}/turns").select("case", "pos", "start", "end", "speaker", "text")


def with_meta(meta: Column, updates: Column) -> Column:
    """Metadata with some keys set; other keys stay and the new value wins."""
    kept = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(updates, k))
    return F.map_concat(kept, updates)


def next_run(spark: SparkSession, folder: str) -> int:
    """A number above those of all runs so far; of several appenders at once each takes another.

    The number is taken by making an empty file of that name, which a file system lets only one succeed in.
    """
    paths = spark._jvm.org.apache.hadoop.fs
    marks = paths.Path(f"{folder}/_runs")
    files = marks.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(marks)
    number = max((int(f.getPath().getName()) for f in files.listStatus(marks)), default=-1) + 1
    while not files.createNewFile(paths.Path(f"{folder}/_runs/{number:08d}")):
        number += 1
    return number


def append_history(rows: DataFrame, folder: str, ts: str, note: str = "", settings: dict[str, str] | None = None, totals: DataFrame | None = None) -> int:
    """Append a run: one JSON line per case, with the run's time, number and note; returns the number.

    With ``settings`` or ``totals`` (a row of ``evals.suite_totals``) the run also gets a line of its own, with the settings'
    fingerprint.
    """
    spark = rows.sparkSession
    run = next_run(spark, folder)
    head = [F.lit(ts).alias("ts"), F.lit(run).cast("long").alias("run"), F.lit(note).alias("note")]
    metrics = [c for c in rows.columns if c != "case"]
    rows.select(*head, F.create_map(F.col("case"), F.struct(*metrics)).alias("cases")).write.mode("append").json(folder)
    if settings is not None or totals is not None:
        taken = F.from_json(F.lit(json.dumps(settings or {})), "MAP<STRING, STRING>")
        facts = totals if totals is not None else spark.range(1).select()
        struct = F.struct(*facts.columns).alias("totals") if totals is not None else F.lit(None).cast(TOTALS).alias("totals")
        facts.select(*head, taken.alias("settings"), fingerprint(taken).alias("fingerprint"), struct).write.mode("append").json(folder)
    return run


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select("value", F.from_json("value", RECORD).alias("r"))


def recorded_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that were recorded with settings or totals: ``run, ts, note, settings, fingerprint, totals``."""
    runs = _records(spark, folder).filter(F.col("r.settings").isNotNull() | F.col("r.totals").isNotNull())
    return runs.select("r.run", "r.ts", "r.note", "r.settings", "r.fingerprint", "r.totals")


def latest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The newest metrics per case; lines that cannot be read are skipped.

    Runs are ordered by their time, of equal times by their number; lines without a number come first, lines that are equal in
    both by their text, so that the order never depends on files or partitions.
    """
    records = _records(spark, folder).filter(F.col("r.cases").isNotNull())
    cases = records.select("r.ts", F.coalesce("r.run", F.lit(-1)).alias("run"), "r.note", "value", F.explode("r.cases").alias("case", "m")).filter(F.col("m").isNotNull())
    newest = F.max_by(F.struct("ts", "note", "m"), F.struct("ts", "run", "value"))
    return cases.groupBy("case").agg(newest.alias("n")).select("case", "n.ts", "n.note", "n.m.*")


def with_latest(cases: DataFrame, metrics: DataFrame) -> DataFrame:
    """The case list with the latest metrics where there are any."""
    return cases.join(metrics.drop("verified"), "case", "left")
