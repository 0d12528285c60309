"""Transcript cleanup, labelling, talk time and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import lines_of, string_or_null, strip
from parlance.operators.intervals import valid
from parlance.operators.scans import Scan, island_ids, prefix_scan
from parlance.session import settle

POSITION_CHUNK = 4096
RENDER_BUDGET = 24_000
PREVIEW_SECONDS = 15.0
WEARER = "USER"


def position_chunk(column: str = "pos", size: int = POSITION_CHUNK) -> Column:
    return F.floor(F.col(column) / size)


def collapse_repeats(segments: DataFrame, min_run: int = 3) -> DataFrame:
    """Fold runs of at least ``min_run`` equal texts into one row marked ``(×N)``.

    Blank texts break a run and are always kept.
    """
    rows = segments.withColumn("norm", F.lower(strip(F.coalesce("text", F.lit("")))))
    runs = settle(
        island_ids(
            rows,
            ["session_id"],
            position_chunk(),
            ["pos"],
            ["norm"],
            lambda prev, cur: (cur["norm"] == "") | (prev["norm"] != cur["norm"]),
            name="run",
        ),
        "runs",
    )
    row = F.struct(*segments.columns)
    long_runs = (
        runs.groupBy("session_id", "run")
        .agg(F.count("*").alias("n"), F.min_by(row, "pos").alias("head"), F.max_by("end", "pos").alias("last_end"))
        .filter(F.col("n") >= min_run)
    )
    kept = runs.join(long_runs.select("session_id", "run"), ["session_id", "run"], "left_anti")
    marked = F.concat(strip(F.col("head.text")), F.lit("  (×"), F.col("n").cast("string"), F.lit(")"))
    folded = long_runs.select(
        *[
            marked.alias(c) if c == "text"
            else F.coalesce("last_end", "head.end").alias(c) if c == "end"
            else F.col(f"head.{c}").alias(c)
            for c in segments.columns
        ]
    )
    return kept.select(*segments.columns).unionByName(folded)


def talk_time(segments: DataFrame) -> DataFrame:
    """Seconds, segments and first position per session and speaker."""
    return (
        valid(segments)
        .groupBy("session_id", "speaker")
        .agg(
            F.sum(F.col("end") - F.col("start")).alias("talk_s"),
            F.count("*").alias("n_segments"),
            F.min("pos").alias("first_pos"),
        )
    )


def talk_ranks(segments: DataFrame) -> DataFrame:
    """Speakers of each session by talk time; ties go to the earlier one."""
    order = Window.partitionBy("session_id").orderBy(F.col("talk_s").desc(), "first_pos")
    return talk_time(segments).withColumn("rank", F.row_number().over(order))


def relabel_by_talk_time(segments: DataFrame) -> DataFrame:
    """The longest talker becomes ``USER``, the others ``S1``, ``S2``… by talk time."""
    label = F.when(F.col("rank") == 1, F.lit(WEARER)).otherwise(
        F.concat(F.lit("S"), (F.col("rank") - 1).cast("string"))
    )
    names = talk_ranks(segments).select("session_id", "speaker", label.alias("label"))
    return (
        segments.join(names, ["session_id", "speaker"], "left")
        .withColumn("speaker", F.coalesce("label", "speaker"))
        .select(*segments.columns)
    )


def longest_segments(segments: DataFrame, preview_s: float = PREVIEW_SECONDS) -> DataFrame:
    """The longest segment of each label (the first wins ties), capped to the preview length."""
    rows = valid(segments)
    best = F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("pos")))
    return (
        rows.groupBy("session_id", "speaker")
        .agg(best.alias("span"))
        .select(
            "session_id",
            "speaker",
            F.col("span.start").alias("preview_start"),
            F.least(F.col("span.end"), F.col("span.start") + preview_s).alias("preview_end"),
        )
    )


def distinct_speakers(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.countDistinct("speaker").alias("n_speakers"))


def label_order(segments: DataFrame) -> DataFrame:
    """Labels of each session with the position of their first segment."""
    labelled = segments.filter(F.col("speaker").isNotNull() & (F.col("speaker") != ""))
    return labelled.groupBy("session_id", "speaker").agg(F.min("pos").alias("first_pos"))


def _running_lines(segments: DataFrame) -> DataFrame:
    """``session_id, pos, line, used``: ``[mm:ss] [SPEAKER] text`` and the characters up to and with it."""
    text = strip(F.coalesce("text", F.lit("")))
    start = F.coalesce("start", F.lit(0.0))
    who = F.when(
        F.col("speaker").isNotNull() & (F.col("speaker") != ""), F.concat(F.lit("["), "speaker", F.lit("] "))
    ).otherwise(F.lit(""))
    clock = F.format_string(
        "[%02d:%02d] ", F.floor(start / 60).cast("long"), F.floor(F.pmod(start, F.lit(60.0))).cast("long")
    )
    lines = segments.filter(text != "").select("session_id", "pos", F.concat(clock, who, text).alias("line"))
    return prefix_scan(
        lines,
        ["session_id"],
        position_chunk(),
        ["pos"],
        {"used": Scan("sum", F.length("line") + 1)},
    )


def rendered_parts(segments: DataFrame, budget: int = RENDER_BUDGET) -> DataFrame:
    """All lines in successive parts per session: ``session_id, part, body``.

    A line belongs to the part that its first character falls into, so a part exceeds ``budget`` by less than a line.
    """
    lines = _running_lines(segments)
    part = F.floor((F.col("used") - F.length("line") - 1) / F.lit(budget)).cast("int")
    grouped = lines.groupBy("session_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("kept"))
    return grouped.select("session_id", "part", F.array_join(F.transform("kept", lambda r: r["line"]), "\n").alias("body"))


def rendered(segments: DataFrame, budget: int = RENDER_BUDGET) -> DataFrame:
    """The lines of each session up to ``budget`` characters; what is cut off is said. ``rendered_parts`` loses nothing."""
    running = _running_lines(segments)
    # At most ``budget`` characters of lines are gathered for one session.
    fits = F.col("used") <= budget
    kept = F.array_sort(F.collect_list(F.when(fits, F.struct("pos", "line"))))
    return running.groupBy("session_id").agg(kept.alias("kept"), F.max(~fits).alias("cut_off")).select(
        "session_id",
        F.concat_ws(
            "\n",
            F.transform("kept", lambda r: r["line"]),
            F.when(F.col("cut_off"), F.lit("... (truncated)")),
        ).alias("body"),
        F.size("kept").cast("long").alias("n_lines"),
        F.col("cut_off").alias("truncated"),
    )


def editing_rows(segments: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """One row per non-blank segment, times rounded to 2 places.

    Sessions of ``transcripts`` (``session_id, text``) without such a row get one untimed
    row per non-blank line of their text.
    """
    rows = segments.filter(string_or_null(F.col("text")).isNotNull()).select(
        "session_id",
        "pos",
        F.bround(F.coalesce("start", F.lit(0.0)), 2).alias("start"),
        F.bround(F.coalesce("end", F.lit(0.0)), 2).alias("end"),
        strip(F.col("text")).alias("text"),
        F.nullif(F.col("speaker"), F.lit("")).alias("speaker"),
    )
    if transcripts is None:
        return rows
    bare = transcripts.join(rows.select("session_id").distinct(), "session_id", "left_anti")
    fallback = bare.select("session_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "text")).select(
        "session_id",
        F.col("pos").cast(rows.schema["pos"].dataType).alias("pos"),
        F.lit(0.0).alias("start"),
        F.lit(0.0).alias("end"),
        "text",
        F.lit(None).cast("string").alias("speaker"),
    )
    return rows.unionByName(fallback)


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    """Rows saved from the editor: those with neither text nor speaker are removed."""
    return rows.filter(
        string_or_null(F.col("text")).isNotNull() | string_or_null(F.col("speaker")).isNotNull()
    )


def resolved_names(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments with the name to show: the linked speaker's name, else the label."""
    names = speakers.select(F.col("id").alias("speaker_id"), F.col("name").alias("__name"), F.lit(True).alias("linked"))
    return segments.join(names, "speaker_id", "left").select(
        *segments.columns,
        F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce(F.nullif(F.col("__name"), F.lit("")), "speaker").alias("display"),
    )


def speaker_rows(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Rows of the speaker panel: one per linked speaker and one per unlinked label.

    Labels belong to the speaker of their first segment; a row starts at its first label.
    """
    labelled = segments.filter(F.col("speaker").isNotNull() & (F.col("speaker") != ""))
    firsts = labelled.groupBy("session_id", "speaker").agg(
        F.min("pos").alias("first_pos"), F.min_by("speaker_id", "pos").alias("speaker_id")
    )
    known = speakers.select(F.col("id").alias("speaker_id"), F.lit(True).alias("linked"))
    rows = firsts.join(known, "speaker_id", "left").withColumns(
        {
            "linked": F.coalesce("linked", F.lit(False)),
            "row_key": F.when(F.col("linked"), F.col("speaker_id")),
            "label_key": F.when(~F.coalesce(F.col("linked"), F.lit(False)), F.col("speaker")),
        }
    )
    # A row gathers the labels of one speaker in one session.
    return rows.groupBy("session_id", "linked", "row_key", "label_key").agg(
        F.min("first_pos").alias("first_pos"),
        F.concat_ws(
            ",", F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "speaker"))), lambda r: r["speaker"])
        ).alias("labels"),
    ).select("session_id", "linked", F.col("row_key").alias("speaker_id"), "labels", "first_pos")


def promote_known_wearer(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Swap labels so that the known wearer of a session is called ``USER``.

    Of several known wearers the one with the most talk time counts (first one on ties).
    """
    wearers = speakers.filter("is_user").select(F.col("id").alias("speaker_id"))
    spoken = segments.join(wearers, "speaker_id", "left_semi")
    start = F.coalesce("start", F.lit(0.0))
    length = F.coalesce(F.nullif(F.col("end"), F.lit(0.0)), start) - start
    per_speaker = spoken.groupBy("session_id", "speaker_id").agg(
        F.sum(F.when(length > 0, length)).alias("talk_s"),
        F.min(F.when(length > 0, F.col("pos"))).alias("first_pos"),
        F.min_by("speaker", F.when(F.col("speaker") != "", F.col("pos"))).alias("label"),
    )
    chosen = (
        per_speaker.filter(F.col("talk_s").isNotNull())
        .groupBy("session_id")
        .agg(F.max_by("label", F.struct("talk_s", -F.col("first_pos"))).alias("__label"))
        .filter(F.col("__label").isNotNull() & (F.col("__label") != WEARER))
    )
    swapped = (
        F.when(F.col("__label").isNull(), F.col("speaker"))
        .when(F.col("speaker") == WEARER, F.col("__label"))
        .when(F.col("speaker") == F.col("__label"), F.lit(WEARER))
        .otherwise(F.col("speaker"))
    )
    return segments.join(chosen, "session_id", "left").withColumn("speaker", swapped).select(*segments.columns)
