"""Queries: transcript cleanup, talk time, labelling, turns, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.functions.text import tokens
from parlance.operators import intervals as iv
from parlance.operators.overlap import intersection_seconds, label_by_overlap
from parlance.plans import transcripts as tr

DAY = 24 * 3600.0
BUCKET_S = 6 * 3600.0

SQL_COLLAPSED = """
normed AS (SELECT *, lower(trim(text)) AS norm FROM lines),
changes AS (SELECT *, CASE WHEN norm <> '' AND norm = LAG(norm) OVER (PARTITION BY session_id ORDER BY pos)
                           THEN 0 ELSE 1 END AS opens FROM normed),
runs AS (SELECT *, SUM(opens) OVER (PARTITION BY session_id ORDER BY pos) AS run FROM changes),
sized AS (SELECT *, COUNT(*) OVER (PARTITION BY session_id, run) AS n,
                 ROW_NUMBER() OVER (PARTITION BY session_id, run ORDER BY pos) AS nth,
                 MAX(end_s) OVER (PARTITION BY session_id, run) AS run_end FROM runs),
collapsed AS (
  SELECT session_id, pos, CASE WHEN n >= 2 THEN trim(text) || '  (×' || n || ')' ELSE text END AS text,
         speaker, start_s, CASE WHEN n >= 2 THEN run_end ELSE end_s END AS end_s
  FROM sized WHERE n < 2 OR nth = 1)"""


@query(
    "collapsed_repeats",
    b.with_cte("lines")
    + ","
    + SQL_COLLAPSED
    + " SELECT session_id, pos, text, speaker, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM collapsed",
)
def collapsed_repeats(spark, d):
    rows = tr.collapse_repeats(b.lines(spark, d), min_run=2)
    return rows.select(
        "session_id", "pos", "text", "speaker", b.r6("start").alias("start_s"), b.r6("end").alias("end_s")
    )


@query(
    "talk_time",
    b.with_cte("segments")
    + """
SELECT session_id, speaker, round(SUM(end_s - start_s), 6) AS talk_s, COUNT(*) AS n_segments, MIN(pos) AS first_pos
FROM segments WHERE end_s > start_s GROUP BY ALL""",
)
def talk_time(spark, d):
    return tr.talk_time(b.segments(spark, d)).select(
        "session_id", "speaker", b.r6("talk_s").alias("talk_s"), "n_segments", "first_pos"
    )


@query(
    "relabelled_by_talk_time",
    b.with_cte("activity", "spoken")
    + """,
talk AS (SELECT session_id, speaker, SUM(end_s - start_s) AS talk_s, MIN(pos) AS first_pos
         FROM spoken WHERE end_s > start_s GROUP BY ALL),
ranks AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY talk_s DESC, first_pos) AS r FROM talk)
SELECT s.session_id, s.pos, CASE WHEN r = 1 THEN 'USER' ELSE 'S' || (r - 1) END AS speaker
FROM spoken s JOIN ranks USING (session_id, speaker)""",
)
def relabelled(spark, d):
    return tr.relabel_by_talk_time(b.spoken(spark, d)).select("session_id", "pos", "speaker")


@query(
    "longest_segments",
    b.with_cte("activity", "spoken")
    + """,
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, speaker ORDER BY end_s - start_s DESC, pos) AS r
         FROM spoken WHERE end_s > start_s)
SELECT session_id, speaker, round(start_s, 6) AS preview_start, round(least(end_s, start_s + 15), 6) AS preview_end
FROM best WHERE r = 1""",
)
def longest_segments(spark, d):
    return tr.longest_segments(b.spoken(spark, d)).select(
        "session_id", "speaker", b.r6("preview_start").alias("preview_start"), b.r6("preview_end").alias("preview_end")
    )


@query(
    "embedding_clips",
    b.with_cte("segments")
    + """
SELECT session_id, pos,
  round(CASE WHEN end_s - start_s > 10 THEN start_s + (end_s - start_s - 10) / 2 ELSE start_s END, 6) AS clip_start,
  round(CASE WHEN end_s - start_s > 10 THEN start_s + (end_s - start_s - 10) / 2 + 10 ELSE end_s END, 6) AS clip_end
FROM segments WHERE end_s - start_s >= 0.5""",
)
def embedding_clips(spark, d):
    return iv.clip_for_embedding(b.segments(spark, d)).select(
        "session_id", "pos", b.r6("clip_start").alias("clip_start"), b.r6("clip_end").alias("clip_end")
    )


@query(
    "speaker_union",
    b.with_cte("activity", "spoken")
    + """,
flags AS (SELECT *, CASE WHEN start_s <= MAX(end_s) OVER (PARTITION BY session_id, speaker ORDER BY start_s, end_s
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM spoken),
ids AS (SELECT *, SUM(opens) OVER (PARTITION BY session_id, speaker ORDER BY start_s, end_s) AS island FROM flags)
SELECT session_id, speaker, round(MIN(start_s), 6) AS start_s, round(MAX(end_s), 6) AS end_s
FROM ids GROUP BY session_id, speaker, island""",
)
def speaker_union(spark, d):
    rows = iv.union_intervals(iv.valid(b.spoken(spark, d)), ["session_id", "speaker"], chunk_s=DAY)
    return rows.select("session_id", "speaker", b.r6("start").alias("start_s"), b.r6("end").alias("end_s"))


SQL_TURNS = """
changed AS (SELECT *, CASE WHEN speaker = LAG(speaker) OVER (PARTITION BY session_id ORDER BY start_s, end_s, speaker)
              THEN 0 ELSE 1 END AS new_run FROM spoken WHERE end_s > start_s),
runs AS (SELECT *, SUM(new_run) OVER (PARTITION BY session_id ORDER BY start_s, end_s, speaker) AS run FROM changed),
gaps AS (SELECT *, CASE WHEN start_s - MAX(end_s) OVER (PARTITION BY session_id, run ORDER BY start_s, end_s
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3600 THEN 0 ELSE 1 END AS opens FROM runs),
ids AS (SELECT *, SUM(opens) OVER (PARTITION BY session_id, run ORDER BY start_s, end_s) AS island FROM gaps),
turns AS (SELECT session_id, speaker, MIN(start_s) AS start_s, MAX(end_s) AS end_s FROM ids
          GROUP BY session_id, run, speaker, island)"""


@query(
    "speaker_turns",
    b.with_cte("activity", "spoken")
    + ","
    + SQL_TURNS
    + " SELECT session_id, speaker, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM turns",
)
def speaker_turns(spark, d):
    rows = iv.turns(b.spoken(spark, d), gap_tolerance_s=3600.0, chunk_s=DAY)
    return rows.select("session_id", "speaker", b.r6("start").alias("start_s"), b.r6("end").alias("end_s"))


def diarized(spark, d):
    """Turns of another labelling: every fourth kind of event, shifted by half an hour."""
    return b.spoken(spark, d).filter(F.col("k") % 4 == 0).select(
        "session_id",
        (F.col("start") + 1800).alias("start"),
        (F.col("end") + 1800).alias("end"),
        F.concat(F.lit("D"), (F.col("k") % 7).cast("string")).alias("speaker"),
    )


SQL_DIARIZED = """
diarized AS (SELECT session_id, start_s + 1800 AS start_s, end_s + 1800 AS end_s, 'D' || (k % 7) AS speaker
             FROM spoken WHERE k % 4 = 0)"""


@query(
    "labels_by_overlap",
    b.with_cte("activity", "spoken")
    + ","
    + SQL_DIARIZED
    + """,
pairs AS (SELECT s.session_id, s.pos, t.speaker,
                 ROW_NUMBER() OVER (PARTITION BY s.session_id, s.pos
                   ORDER BY least(s.end_s, t.end_s) - greatest(s.start_s, t.start_s) DESC, t.start_s, t.end_s) AS r
          FROM spoken s JOIN diarized t ON s.session_id = t.session_id AND s.start_s < t.end_s AND t.start_s < s.end_s)
SELECT s.session_id, s.pos, COALESCE(p.speaker, s.speaker) AS speaker
FROM spoken s LEFT JOIN pairs p ON s.session_id = p.session_id AND s.pos = p.pos AND p.r = 1""",
)
def labels_by_overlap(spark, d):
    rows = label_by_overlap(b.spoken(spark, d), diarized(spark, d), bucket_s=BUCKET_S)
    return rows.select("session_id", "pos", "speaker")


@query(
    "shared_speech",
    b.with_cte("activity", "spoken")
    + """
SELECT a.session_id, round(SUM(least(a.end_s, c.end_s) - greatest(a.start_s, c.start_s)), 6) AS shared_s
FROM spoken a JOIN spoken c ON a.session_id = c.session_id AND a.start_s < c.end_s AND c.start_s < a.end_s
WHERE a.speaker = 'view' AND c.speaker = 'click' GROUP BY a.session_id""",
)
def shared_speech(spark, d):
    rows = b.spoken(spark, d)
    shared = intersection_seconds(
        rows.filter("speaker = 'view'"), rows.filter("speaker = 'click'"), ["session_id"], bucket_s=BUCKET_S
    )
    return shared.select("session_id", F.round("shared_s", 6).alias("shared_s"))


@query(
    "distinct_speakers",
    b.with_cte("segments") + " SELECT session_id, COUNT(DISTINCT speaker) AS n_speakers FROM segments GROUP BY ALL",
)
def distinct_speakers(spark, d):
    return tr.distinct_speakers(b.segments(spark, d))


@query(
    "label_order",
    b.with_cte("segments") + " SELECT session_id, speaker, MIN(pos) AS first_pos FROM segments GROUP BY ALL",
)
def label_order(spark, d):
    return tr.label_order(b.segments(spark, d))


@query(
    "rendered_transcripts",
    b.with_cte("lines")
    + """,
clocked AS (SELECT session_id, pos, '[' || lpad(CAST(CAST(start_s AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':'
    || lpad(CAST(CAST(start_s AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] [' || speaker || '] ' || trim(text) AS line
  FROM lines WHERE trim(text) <> ''),
used AS (SELECT *, SUM(length(line) + 1) OVER (PARTITION BY session_id ORDER BY pos) AS used FROM clocked)
SELECT session_id,
       concat_ws(chr(10), string_agg(line, chr(10) ORDER BY pos) FILTER (used <= 6000),
                 CASE WHEN max(used) > 6000 THEN '... (truncated)' END) AS body,
       COUNT(*) FILTER (used <= 6000) AS n_lines, max(used) > 6000 AS truncated
FROM used GROUP BY session_id""",
)
def rendered_transcripts(spark, d):
    return tr.rendered(b.lines(spark, d), budget=6000)


@query(
    "editing_rows",
    b.with_cte("segments")
    + """
SELECT session_id, pos, trim(text) AS text, speaker,
       round_even(start_s, 2) AS start_s, round_even(end_s, 2) AS end_s
FROM segments WHERE trim(text) <> ''""",
)
def editing_rows(spark, d):
    rows = tr.editing_rows(b.segments(spark, d))
    return rows.select(
        "session_id", "pos", "text", "speaker", F.col("start").alias("start_s"), F.col("end").alias("end_s")
    )


@query(
    "untimed_fallback_rows",
    """
SELECT doc_id AS session_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, trim(parts[i]) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
     LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)
WHERE trim(parts[i]) <> ''""",
)
def untimed_fallback_rows(spark, d):
    from parlance.sources.tables import given

    docs = given(spark, d, "documents").select(F.col("doc_id").alias("session_id"), "text")
    none = b.lines(spark, d).filter(F.lit(False))
    return tr.editing_rows(none, docs).select("session_id", "pos", "text")


@query(
    "scoring_tokens",
    """
SELECT conv_id, turn, CAST(len(words) AS BIGINT) AS n_words, array_to_string(words, ' ') AS words
FROM (SELECT conv_id, turn, list_filter(string_split(
        regexp_replace(regexp_replace(lower(nfc_normalize(text)), '\\(×\\d+\\)', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'),
        ' '), lambda w: w <> '') AS words FROM conversations)""",
)
def scoring_tokens(spark, d):
    from parlance.sources.tables import given

    rows = given(spark, d, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("words"))
    return rows.select(
        "conv_id", "turn", F.size("words").cast("long").alias("n_words"), F.concat_ws(" ", "words").alias("words")
    )


@query(
    "transferred_labels",
    b.with_cte("activity", "spoken")
    + ","
    + SQL_TURNS
    + """,
fresh AS (SELECT session_id, pos, start_s + 900 AS start_s, end_s + 900 AS end_s FROM spoken),
pairs AS (SELECT f.session_id, f.pos, t.speaker, ROW_NUMBER() OVER (PARTITION BY f.session_id, f.pos
    ORDER BY least(f.end_s, t.end_s) - greatest(f.start_s, t.start_s) DESC, t.start_s, t.end_s) AS r
  FROM fresh f JOIN turns t ON f.session_id = t.session_id AND f.start_s < t.end_s AND t.start_s < f.end_s)
SELECT f.session_id, f.pos, p.speaker FROM fresh f LEFT JOIN pairs p ON p.session_id = f.session_id AND p.pos = f.pos AND p.r = 1""",
)
def transferred_labels(spark, d):
    """Labels carried from stored turns to segments transcribed anew, a quarter of an hour off."""
    stored = iv.turns(b.spoken(spark, d), gap_tolerance_s=3600.0, chunk_s=DAY)
    fresh = b.spoken(spark, d).select(
        "session_id", "pos", (F.col("start") + 900).alias("start"), (F.col("end") + 900).alias("end"),
        F.lit(None).cast("string").alias("speaker"),
    )
    return label_by_overlap(fresh, stored, bucket_s=BUCKET_S).select("session_id", "pos", "speaker")


@query(
    "saved_rows",
    b.with_cte("lines") + " SELECT session_id, pos FROM lines WHERE trim(text) <> '' OR pos % 2 = 0",
)
def saved_rows(spark, d):
    speaker = F.when(F.col("pos") % 2 == 0, F.col("speaker")).otherwise(F.lit(" "))
    return tr.drop_blank_rows(b.lines(spark, d).withColumn("speaker", speaker)).select("session_id", "pos")


@query(
    "framed_activity",
    b.with_cte("activity")
    + " SELECT user_id, CAST(floor(t / 0.032e0) AS BIGINT) AS frame_idx, count(*) AS n, round(max(least(value / 5e1, 1)), 6) AS prob FROM activity GROUP BY ALL",
)
def framed_activity(spark, d):
    from parlance.plans.segmentation import frame_index

    rows = b.activity(spark, d).groupBy("user_id", frame_index(F.col("t")).alias("frame_idx"))
    return rows.agg(
        F.count("*").alias("n"), b.r6(F.max(F.least(F.col("value") / F.lit(50.0), F.lit(1.0)))).alias("prob")
    )
