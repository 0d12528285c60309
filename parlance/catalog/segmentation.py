"""Queries: activity gaps, hysteresis, silences, conversation cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.plans import segmentation as seg
from parlance.session import settle

GAP_S = 12 * 3600.0
FRAME_S = 0.5

# Frames of half a second; hysteresis 0.5 / 0.35, bridging below 2 s, speech of at least 1 s.
PARAMS = {"frame_s": FRAME_S, "threshold": 0.5, "neg_threshold": 0.35}
SQL_REGIONS = f"""
states AS (
  SELECT session_id, frame_idx,
         last_value(CASE WHEN prob >= 0.5 THEN 1 WHEN prob < 0.35 THEN 0 END IGNORE NULLS) OVER (
           PARTITION BY session_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS state
  FROM frames),
speech AS (SELECT session_id, frame_idx,
                  frame_idx - ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY frame_idx) AS grp
           FROM states WHERE state = 1),
regions AS (SELECT session_id, MIN(frame_idx) * {FRAME_S} AS s, (MAX(frame_idx) + 1) * {FRAME_S} AS e
            FROM speech GROUP BY session_id, grp),
durations AS (SELECT session_id, COUNT(*) * {FRAME_S} AS duration_s FROM frames GROUP BY session_id)"""
SQL_SILENCES = SQL_REGIONS + """,
flags AS (SELECT *, CASE WHEN s - MAX(e) OVER (PARTITION BY session_id ORDER BY s
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 2 THEN 0 ELSE 1 END AS opens FROM regions),
ids AS (SELECT *, SUM(opens) OVER (PARTITION BY session_id ORDER BY s) AS island FROM flags),
merged AS (SELECT session_id, MIN(s) AS s, MAX(e) AS e FROM ids GROUP BY session_id, island),
kept AS (SELECT session_id, s, least(e, duration_s) AS e, duration_s FROM merged JOIN durations USING (session_id)
         WHERE least(e, duration_s) - s >= 1),
inner_gaps AS (SELECT session_id, LAG(e) OVER (PARTITION BY session_id ORDER BY s) AS start_s, s AS end_s FROM kept),
spans AS (SELECT d.session_id, d.duration_s, MIN(k.s) AS first_s, MAX(k.e) AS last_e
          FROM durations d LEFT JOIN kept k USING (session_id) GROUP BY ALL),
silences AS (
  SELECT session_id, start_s, end_s FROM inner_gaps WHERE start_s IS NOT NULL
  UNION ALL SELECT session_id, 0e0, first_s FROM spans WHERE first_s >= 2
  UNION ALL SELECT session_id, last_e, duration_s FROM spans WHERE duration_s - last_e >= 2
  UNION ALL SELECT session_id, 0e0, duration_s FROM spans WHERE first_s IS NULL)"""
SQL_CUTS = SQL_SILENCES + """,
edges AS (SELECT d.session_id, d.duration_s,
    arg_min(si.start_s, si.start_s) AS hs, arg_min(si.end_s, si.start_s) AS he,
    arg_max(si.start_s, si.start_s) AS ts, arg_max(si.end_s, si.start_s) AS te
  FROM durations d LEFT JOIN silences si USING (session_id) GROUP BY ALL),
windows AS (SELECT session_id, duration_s,
    CASE WHEN hs <= 0.05 AND he - hs >= 6 THEN he ELSE 0 END AS ss,
    CASE WHEN te >= duration_s - 0.05 AND te - ts >= 6 THEN ts ELSE duration_s END AS se FROM edges),
live AS (SELECT * FROM windows WHERE se > ss AND duration_s > 0),
splits AS (SELECT si.session_id, si.start_s, si.end_s, ss, se, duration_s FROM silences si JOIN live USING (session_id)
           WHERE si.end_s - si.start_s >= 6 AND si.start_s > ss AND si.end_s < se),
cuts AS (
  SELECT session_id, duration_s, COALESCE(LAG(end_s) OVER (PARTITION BY session_id ORDER BY start_s), ss) AS f, start_s AS t
  FROM splits
  UNION ALL
  SELECT l.session_id, l.duration_s, COALESCE(MAX(s.end_s), l.ss), l.se
  FROM live l LEFT JOIN splits s USING (session_id) GROUP BY l.session_id, l.duration_s, l.ss, l.se),
convs AS (SELECT session_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY f) - 1 AS idx,
                 greatest(0, f - 0.25) AS start_s, least(duration_s, t + 0.25) AS end_s FROM cuts WHERE t > f)"""


def durations(frames):
    return settle(frames.groupBy("session_id").agg((F.count("*") * F.lit(FRAME_S)).alias("duration_s")), "durations")


def silences(spark, d):
    frames = b.frames(spark, d)
    lasting = durations(frames)
    return lasting, seg.silences_from_frames(frames, lasting, min_speech_s=1.0, min_silence_s=2.0, **PARAMS)


def cuts(spark, d):
    lasting, found = silences(spark, d)
    return seg.conversations_from_silences(lasting, found, gap_threshold_s=6.0, pad_s=0.25)


def out(df):
    return df.select("session_id", b.r6("start").alias("start_s"), b.r6("end").alias("end_s"))


@query(
    "activity_conversations",
    b.with_cte("activity")
    + f""",
flags AS (SELECT *, CASE WHEN t - LAG(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < {GAP_S}
                         THEN 0 ELSE 1 END AS opens FROM activity),
ids AS (SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY t, event_id) AS idx FROM flags)
SELECT user_id, CAST(idx AS BIGINT) AS idx, round(MIN(t), 6) AS start_s, round(MAX(t), 6) AS end_s,
       COUNT(*) AS n_events FROM ids GROUP BY user_id, idx""",
)
def activity_conversations(spark, d):
    rows = seg.activity_conversations(b.activity(spark, d), GAP_S)
    return rows.select("user_id", "idx", b.r6("start_s").alias("start_s"), b.r6("end_s").alias("end_s"), "n_events")


@query(
    "speech_regions",
    b.with_cte("frames") + "," + SQL_REGIONS + " SELECT session_id, round(s, 6) AS start_s, round(e, 6) AS end_s FROM regions",
)
def speech_regions(spark, d):
    return out(seg.speech_regions(b.frames(spark, d), **PARAMS))


@query(
    "frame_silences",
    b.with_cte("frames")
    + ","
    + SQL_SILENCES
    + " SELECT session_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM silences",
)
def frame_silences(spark, d):
    return out(silences(spark, d)[1])


@query(
    "silence_cut_conversations",
    b.with_cte("frames")
    + ","
    + SQL_CUTS
    + " SELECT session_id, CAST(idx AS BIGINT) AS idx, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM convs",
)
def silence_cut_conversations(spark, d):
    rows = cuts(spark, d)
    return rows.select("session_id", "idx", b.r6("start").alias("start_s"), b.r6("end").alias("end_s"))


SWEEP = [
    {"threshold": 0.5, "min_speech_s": 1.0, "min_silence_s": 2.0, "gap_s": 6.0, "pad_s": 0.25},
    {"threshold": 0.5, "min_speech_s": 1.0, "min_silence_s": 2.0, "gap_s": 1e9, "pad_s": 0.25},
]


@query(
    "parameter_sweep",
    b.with_cte("frames")
    + ","
    + SQL_CUTS
    + """,
kept_ AS (SELECT session_id, count(*) AS n, sum(end_s - start_s) AS s FROM convs GROUP BY ALL)
SELECT CAST(0 AS INTEGER) AS setting, d.session_id, COALESCE(n, 0) AS n_conversations, round(COALESCE(s, 0), 6) AS speech_s,
       round(COALESCE(s, 0) / duration_s * 100, 5) AS speech_pct FROM durations d LEFT JOIN kept_ USING (session_id)
UNION ALL SELECT 1, session_id, 1, round(duration_s, 6), 100 FROM durations""",
)
def parameter_sweep(spark, d):
    frames = b.frames(spark, d)
    rows = seg.parameter_sweep(frames, durations(frames), SWEEP, FRAME_S)
    return rows.withColumns({"speech_s": b.r6("speech_s"), "speech_pct": F.round("speech_pct", 5)})
