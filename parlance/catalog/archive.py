"""Queries: lists, details, dashboard, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.functions import values as fv
from parlance.plans import archive as ar
from parlance.sources.tables import given

USER = "src3"
AS_OF = b.AS_OF
EFF = "COALESCE(quality_override, quality_score)"


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


@query(
    "conversation_list",
    b.with_cte("conv")
    + f" SELECT id, title, {ts('started_at')} AS started_at FROM conv WHERE user_id = '{USER}' ORDER BY conv.started_at DESC, id LIMIT 20 OFFSET 5",
)
def conversation_list(spark, d):
    rows = ar.conversation_list(b.conv(spark, d), USER, limit=20, offset=5)
    return rows.select("id", "title", b.stamp("started_at").alias("started_at"))


@query(
    "conversation_quality",
    b.with_cte("conv")
    + f"""
SELECT id, round({EFF}, 6) AS quality,
       CASE WHEN {EFF} < 0.3 THEN 'noise' WHEN {EFF} < 0.7 THEN 'normal' ELSE 'substantive' END AS bucket
FROM conv""",
)
def conversation_quality(spark, d):
    eff = ar.effective_quality()
    return b.conv(spark, d).select("id", b.r6(eff).alias("quality"), ar.quality_bucket(eff).alias("bucket"))


@query(
    "index_page",
    b.with_cte("activity", "conv", "cal", "tasks")
    + f""",
newest AS (SELECT *, {EFF} AS quality FROM conv WHERE user_id = '{USER}' ORDER BY started_at DESC, id LIMIT 200),
kept AS (SELECT * FROM newest WHERE quality >= 0.3 ORDER BY started_at DESC, id LIMIT 100)
SELECT k.id, COALESCE(NULLIF(title, ''), '(untitled)') AS title, COALESCE(summary, '') AS summary, {ts('k.started_at')} AS started_at,
  round(quality, 6) AS quality, CASE WHEN quality < 0.7 THEN 'normal' ELSE 'substantive' END AS bucket,
  (SELECT count(*) FROM cal WHERE conversation_id = k.id) AS n_events,
  (SELECT count(*) FROM tasks WHERE conversation_id = k.id AND status = 'open') AS n_open_actions
FROM kept k""",
)
def index_page(spark, d):
    rows = ar.index_page(b.conv(spark, d), b.cal(spark, d), b.tasks(spark, d), USER)
    return rows.withColumns({"started_at": b.stamp("started_at"), "quality": b.r6("quality")})


@query(
    "hidden_count",
    b.with_cte("conv")
    + f""",
newest AS (SELECT {EFF} AS q FROM conv ORDER BY started_at DESC, id LIMIT 200)
SELECT count(*) FILTER (q < 0.7) AS hidden FROM newest""",
)
def hidden_count(spark, d):
    return ar.hidden_count(b.conv(spark, d), None, "substantive")


@query(
    "child_counts",
    b.with_cte("activity", "conv", "cal", "tasks")
    + """,
e AS (SELECT conversation_id, count(*) AS n FROM cal GROUP BY ALL),
t AS (SELECT conversation_id, count(*) AS n FROM tasks WHERE status = 'open' GROUP BY ALL)
SELECT c.id, COALESCE(e.n, 0) AS n_events, COALESCE(t.n, 0) AS n_open_actions
FROM conv c LEFT JOIN e ON e.conversation_id = c.id LEFT JOIN t ON t.conversation_id = c.id""",
)
def child_counts(spark, d):
    return ar.child_counts(b.cal(spark, d), b.tasks(spark, d), b.conv(spark, d))


@query(
    "upcoming_events",
    b.with_cte("activity", "conv", "cal")
    + f"""
SELECT e.id, e.title, {ts('e.starts_at')} AS starts_at, c.title AS conversation_title, round(confidence, 6) AS confidence
FROM cal e JOIN conv c ON c.id = e.conversation_id
WHERE e.confidence >= 0.2 AND e.starts_at >= TIMESTAMP '{AS_OF}' ORDER BY e.starts_at, e.id LIMIT 500""",
)
def upcoming_events(spark, d):
    rows = ar.event_list(b.cal(spark, d), b.conv(spark, d), None, AS_OF, min_confidence=0.2, limit=500)
    return rows.select("id", "title", b.stamp("starts_at").alias("starts_at"), "conversation_title", b.r6("confidence").alias("confidence"))


@query(
    "events_page",
    b.with_cte("activity", "conv", "cal")
    + f""",
joined AS (SELECT e.id, e.starts_at FROM cal e JOIN conv c ON c.id = e.conversation_id),
ahead AS (SELECT *, 'upcoming' AS part FROM joined WHERE starts_at >= TIMESTAMP '{AS_OF}' ORDER BY starts_at, id LIMIT 100),
past AS (SELECT *, 'past' AS part FROM joined WHERE starts_at < TIMESTAMP '{AS_OF}' ORDER BY starts_at DESC, id LIMIT 20)
SELECT id, {ts('starts_at')} AS starts_at, part FROM (SELECT * FROM ahead UNION ALL SELECT * FROM past)""",
)
def events_page(spark, d):
    rows = ar.events_page(b.cal(spark, d), b.conv(spark, d), None, AS_OF)
    return rows.select("id", b.stamp("starts_at").alias("starts_at"), "part")


@query(
    "action_list",
    b.with_cte("conv", "tasks")
    + f"""
SELECT t.id, t.text, t.owner, {ts('t.due_at')} AS due_at, c.title AS conversation_title
FROM tasks t JOIN conv c ON c.id = t.conversation_id WHERE t.status = 'open' ORDER BY t.due_at ASC NULLS LAST, t.id LIMIT 200""",
)
def action_list(spark, d):
    rows = ar.action_list(b.tasks(spark, d), b.conv(spark, d), None, status="no such", limit=200)
    return rows.select("id", "text", "owner", b.stamp("due_at").alias("due_at"), "conversation_title")


SQL_PEOPLE = """
grouped AS (SELECT lower(trim(m.name)) AS person, count(*) AS mention_count, arg_max(m.name, {'t': m.mentioned_at, 'i': m.id}) AS name,
   arg_max(m.context, {'t': m.mentioned_at, 'i': m.id}) AS context, arg_max(m.conversation_id, {'t': m.mentioned_at, 'i': m.id}) AS conversation_id,
   max(m.mentioned_at) AS mentioned_at
 FROM %s m JOIN conv c ON c.id = m.conversation_id GROUP BY ALL)
SELECT person, mention_count, name, context, conversation_id, strftime(mentioned_at, '%%Y-%%m-%%d %%H:%%M:%%S') AS mentioned_at FROM grouped"""


def people_out(rows):
    return rows.select("person", "mention_count", "name", "context", "conversation_id", b.stamp("mentioned_at").alias("mentioned_at"))


@query("people_rollup", b.with_cte("activity", "conv", "mentions") + "," + SQL_PEOPLE % "mentions")
def people_rollup(spark, d):
    return people_out(ar.people(b.mentions(spark, d), b.conv(spark, d), limit=None))


@query(
    "people_of_recent_mentions",
    b.with_cte("activity", "conv", "mentions")
    + ", recent AS (SELECT m.* FROM mentions m JOIN conv c ON c.id = m.conversation_id ORDER BY mentioned_at DESC, m.id DESC LIMIT 300),"
    + SQL_PEOPLE % "recent"
    + " ORDER BY mention_count DESC, grouped.mentioned_at DESC, person LIMIT 30",
)
def people_of_recent_mentions(spark, d):
    return people_out(ar.people(b.mentions(spark, d), b.conv(spark, d), limit=30, recent_rows=300))


@query(
    "invocations_with_action",
    b.with_cte("activity", "actions", "fired")
    + " SELECT f.id, a.name AS action, f.matched_phrase FROM fired f JOIN actions a ON a.id = f.wake_action_id",
)
def invocations_with_action(spark, d):
    return ar.invocations_of(b.fired(spark, d), b.actions(spark, d)).select("id", "action", "matched_phrase")


@query(
    "latest_invocations",
    b.with_cte("activity", "fired")
    + """
SELECT wake_action_id, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY wake_action_id ORDER BY created_at DESC, id DESC) AS r FROM fired)
WHERE r <= 3""",
)
def latest_invocations(spark, d):
    return ar.latest_invocations(b.fired(spark, d)).select("wake_action_id", "id")


@query(
    "invocation_log",
    b.with_cte("activity", "fired") + " SELECT id, matched_phrase FROM fired WHERE wake_action_id = 7 ORDER BY created_at DESC, id DESC LIMIT 200",
)
def invocation_log(spark, d):
    return ar.invocation_log(b.fired(spark, d), 7).select("id", "matched_phrase")


@query(
    "latest_transcripts",
    b.with_cte("versions")
    + """
SELECT audio_session_id, id, text, language FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY audio_session_id ORDER BY created_at DESC, id DESC) AS r FROM versions) WHERE r = 1""",
)
def latest_transcripts(spark, d):
    return ar.latest_transcripts(b.versions(spark, d)).select("audio_session_id", "id", "text", "language")


@query(
    "transcripts_of_user",
    b.with_cte("sessions", "versions")
    + " SELECT v.id, s.user_id FROM versions v JOIN sessions s ON s.id = v.audio_session_id WHERE s.user_id = 'u7'",
)
def transcripts_of_user(spark, d):
    return ar.transcripts_of(b.versions(spark, d), b.sessions(spark, d), "u7").select("id", "user_id")


@query(
    "detail_rows",
    b.with_cte("activity", "conv", "cal", "tasks", "decided", "mentions", "fired", "versions")
    + """,
latest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY audio_session_id ORDER BY created_at DESC, id DESC) AS r FROM versions) WHERE r = 1),
rows_ AS (
  SELECT c.id AS conversation_id, 'transcript' AS section, v.id AS item_id FROM latest v JOIN conv c ON c.audio_session_id = v.audio_session_id
  UNION ALL SELECT conversation_id, 'event', id FROM cal
  UNION ALL SELECT conversation_id, 'action', id FROM tasks WHERE status = 'open'
  UNION ALL SELECT conversation_id, 'decision', id FROM decided
  UNION ALL SELECT conversation_id, 'person', id FROM mentions
  UNION ALL SELECT conversation_id, 'invocation', id FROM fired)
SELECT r.* FROM rows_ r WHERE conversation_id IN (SELECT id FROM conv)""",
)
def detail_rows(spark, d):
    return ar.detail_rows(
        b.conv(spark, d), b.versions(spark, d), b.cal(spark, d), b.tasks(spark, d), b.decided(spark, d),
        b.mentions(spark, d), b.fired(spark, d),
    ).select("conversation_id", "section", "item_id")


@query(
    "conversation_payload",
    b.with_cte("conv")
    + """
SELECT id, '{"id":' || id || CASE WHEN title IS NULL THEN '' ELSE ',"title":' || CAST(to_json(title) AS VARCHAR) END
  || CASE WHEN summary IS NULL THEN '' ELSE ',"summary":"' || summary || '"' END
  || ',"started_at":"' || strftime(started_at, '%Y-%m-%dT%H:%M:%S') || '","created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}' AS payload
FROM conv""",
)
def conversation_payload(spark, d):
    return ar.conversation_payload(b.conv(spark, d))


@query(
    "tunable_sessions",
    b.with_cte("conv", "sessions", "versions")
    + f"""
SELECT s.id, {ts('s.started_at')} AS started_at, CAST(c.id AS VARCHAR) AS conversation_id,
       EXISTS (SELECT 1 FROM versions v WHERE v.audio_session_id = s.id) AS has_transcript
FROM (SELECT * FROM sessions WHERE audio_path IS NOT NULL ORDER BY started_at DESC, id DESC LIMIT 50) s
LEFT JOIN conv c ON c.audio_session_id = s.id""",
)
def tunable_sessions(spark, d):
    rows = ar.tunable_sessions(b.sessions(spark, d), b.conv(spark, d), b.versions(spark, d), None)
    return rows.withColumns({"started_at": b.stamp("started_at"), "conversation_id": F.col("conversation_id").cast("string")})


@query(
    "in_progress_panel",
    b.with_cte("sessions")
    + f""" SELECT id, status, {ts('started_at')} AS started_at FROM sessions
WHERE status IN ('pending_vad', 'pending_stt', 'pending_llm', 'failed') ORDER BY sessions.started_at DESC, id DESC LIMIT 10""",
)
def in_progress_panel(spark, d):
    return ar.in_progress(b.sessions(spark, d), None).select("id", "status", b.stamp("started_at").alias("started_at"))


@query("status_counts", b.with_cte("sessions") + " SELECT status, count(*) AS n FROM sessions GROUP BY status")
def status_counts(spark, d):
    return ar.status_counts(b.sessions(spark, d))


@query(
    "recent_activity",
    b.with_cte("conv")
    + f"""
SELECT count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS last_day,
       arg_max(id, {{'t': started_at, 'i': id}}) AS last_id, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_started_at
FROM conv WHERE created_at <= TIMESTAMP '{AS_OF}'""",
)
def recent_activity(spark, d):
    return ar.recent_activity(b.conv(spark, d), AS_OF).withColumn("last_started_at", b.stamp("last_started_at"))


@query(
    "recent_failures",
    b.with_cte("sessions")
    + """ SELECT id, error_msg FROM sessions WHERE status = 'failed' AND started_at >= TIMESTAMP '1997-05-27 00:00:00'
AND started_at <= TIMESTAMP '1997-05-28 00:00:00' ORDER BY started_at DESC, id DESC LIMIT 10""",
)
def recent_failures(spark, d):
    return ar.recent_failures(b.sessions(spark, d), "1997-05-28 00:00:00").select("id", "error_msg")


@query(
    "storage_footprint",
    b.with_cte("sessions")
    + " SELECT CAST(sum(bytes_written) AS BIGINT) AS total_bytes, count(*) AS n_files FROM sessions WHERE audio_path IS NOT NULL",
)
def storage_footprint(spark, d):
    return ar.storage_footprint(b.sessions(spark, d).filter(F.col("audio_path").isNotNull()))


@query(
    "pending_queue",
    b.with_cte("sessions") + f" SELECT id, {ts('started_at')} AS started_at FROM sessions WHERE status = 'pending_stt' ORDER BY sessions.started_at, id",
)
def pending_queue(spark, d):
    return ar.pending(b.sessions(spark, d), "pending_stt").select("id", b.stamp("started_at").alias("started_at"))


@query(
    "retention_candidates",
    b.with_cte("sessions")
    + """ SELECT id, audio_path FROM sessions WHERE NOT archived AND audio_path LIKE '/audio/%' AND status IN ('done', 'segmented')
AND started_at < TIMESTAMP '2000-01-31 00:00:00' - INTERVAL 30 DAY""",
)
def retention_candidates(spark, d):
    return ar.retention_candidates(b.sessions(spark, d), "2000-01-31 00:00:00", 30, "/audio").select("id", "audio_path")


@query(
    "shown_values",
    """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_totalprice < 60 THEN printf('%.1fs', o_totalprice)
       WHEN floor(o_totalprice) < 3600 THEN printf('%dm %02ds', CAST(floor(o_totalprice) AS BIGINT) // 60, CAST(floor(o_totalprice) AS BIGINT) % 60)
       ELSE printf('%dh %02dm', CAST(floor(o_totalprice) AS BIGINT) // 3600, CAST(floor(o_totalprice) AS BIGINT) // 60 % 60) END AS duration,
  CASE WHEN o_orderkey < 1024 THEN o_orderkey || ' B' ELSE printf('%.1f KB', o_orderkey / 1024) END AS bytes,
  'ogg' AS codec, 'audio/ogg' AS media_type
FROM orders""",
)
def shown_values(spark, d):
    codec = fv.codec_of(F.concat(F.lit("/audio/"), F.col("o_orderkey").cast("string"), F.lit(".OGG")))
    return given(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        fv.shown_time(F.col("o_orderdate")).alias("at"),
        fv.shown_date(F.col("o_orderdate")).alias("day"),
        fv.shown_duration(F.col("o_totalprice")).alias("duration"),
        fv.shown_bytes(F.col("o_orderkey")).alias("bytes"),
        codec.alias("codec"),
        fv.media_type_of(codec).alias("media_type"),
    )


@query(
    "silence_coverage",
    """
WITH gaps AS (SELECT user_id, epoch_us(ts) / 1e6 - LAG(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT user_id AS session_id, count(*) AS n_silences, count(*) FILTER (g >= 43200) AS n_splits FROM gaps WHERE g IS NOT NULL GROUP BY ALL""",
)
def silence_coverage(spark, d):
    from parlance.operators.intervals import time_chunk
    from parlance.operators.scans import Scan, prefix_scan

    rows = b.activity(spark, d).select(F.col("user_id").alias("session_id"), "event_id", F.col("t").alias("end"))
    gaps = prefix_scan(
        rows, ["session_id"], time_chunk("end", 86400.0), ["end", "event_id"],
        {"start": Scan("last", F.col("end"), inclusive=False)},
    ).filter(F.col("start").isNotNull())
    return ar.silence_coverage(gaps, 43200.0)


@query(
    "speech_summary",
    b.with_cte("activity", "spoken")
    + """,
u AS (SELECT session_id, sum(end_s - start_s) FILTER (speaker = 'view') AS s, max(end_s) AS duration_s FROM spoken GROUP BY ALL)
SELECT session_id, round(COALESCE(s, 0), 6) AS speech_s, round(COALESCE(s, 0) / duration_s * 100, 5) AS speech_pct,
       round(100 - COALESCE(s, 0) / duration_s * 100, 5) AS saved_pct FROM u""",
)
def speech_summary(spark, d):
    rows = b.spoken(spark, d)
    durations = rows.groupBy("session_id").agg(F.max("end").alias("duration_s"))
    out = ar.speech_summary(rows.filter("speaker = 'view'"), durations)
    return out.select(
        "session_id", F.round("speech_s", 6).alias("speech_s"),
        *[F.round(c, 5).alias(c) for c in ("speech_pct", "saved_pct")],
    )


@query(
    "guarded_paths",
    """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/audio/a/x.ogg' WHEN 1 THEN '/x.ogg' WHEN 2 THEN '/audio/x.ogg' WHEN 3 THEN '/audiox/x.ogg' WHEN 4 THEN '/audio' ELSE '/x/audio/x.ogg' END AS path,
       page_id % 6 IN (0, 2) AS inside FROM pages""",
)
def guarded_paths(spark, d):
    """Stored paths, once normal, and whether they lie below the root."""
    forms = ("/audio/./a//x.ogg", "/audio/../x.ogg", "/audio/b/../x.ogg", "/audiox/x.ogg", "/audio/a/..", "/../x/audio/x.ogg")
    path = F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % 6 + 1).cast("int"))
    return given(spark, d, "pages").select("page_id", ar.normal_path(path).alias("path"), ar.below(path, "/audio/").alias("inside"))


@query(
    "local_days",
    """
SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d') AS today, strftime(ts + INTERVAL 5 HOUR - INTERVAL 1 DAY, '%Y-%m-%d') AS before,
       strftime(ts + INTERVAL 5 HOUR + INTERVAL 1 DAY, '%Y-%m-%d') AS after, strftime(ts, '%Y-%m-%d') AS elsewhere FROM events""",
)
def local_days(spark, d):
    """The local day of each event with its neighbours; an unknown zone counts as UTC."""
    shown = lambda day: F.date_format(day, "yyyy-MM-dd")
    today = fv.local_day(F.col("ts"), "Etc/GMT-5")
    before, after = fv.neighbour_days(today)
    return given(spark, d, "events").select(
        "event_id", shown(today).alias("today"), shown(before).alias("before"), shown(after).alias("after"),
        shown(fv.local_day(F.col("ts"), "Nowhere/None")).alias("elsewhere"),
    )
