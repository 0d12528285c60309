"""Queries: streams over the given tables, and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.catalog.speakers import SQL_ORDERED
from parlance.catalog.triggers import SQL_MATCHES, action
from parlance.sources.tables import given
from parlance.streaming import live
from parlance.streaming import rollover as ro
from parlance.streaming import voices

INTERVAL_S = 24 * 3600.0


def packets(events):
    """Events as packets: sign-ups start audio, errors stop it, the rest are packets."""
    kind = (
        F.when(F.col("event_type") == "signup", ro.START)
        .when(F.col("event_type") == "error", ro.STOP)
        .otherwise(ro.PACKET)
    )
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("user_id").alias("connection_id"),
        "ts",
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes"),
        F.when(F.col("event_type") == "signup", k).alias("rate"),
    )


SQL_ROLLOVER = """
p AS (SELECT user_id AS id, epoch_us(ts) AS us, event_type AS kind, CAST(floor(value * 100) AS BIGINT) AS bytes,
   CASE WHEN event_type = 'signup' THEN k END AS new_rate, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM activity),
walk AS (
  SELECT DISTINCT id, 0::BIGINT AS r, 0::BIGINT AS n, 0::BIGINT AS size, 0::BIGINT AS opened, 0::BIGINT AS rate, 0::BIGINT AS nxt,
    NULL::BIGINT[] AS rolled, NULL::BIGINT[] AS stopped FROM p
  UNION ALL
  SELECT id, r, CASE WHEN kind = 'error' THEN 0 WHEN packet THEN n + 1 ELSE n END,
    CASE WHEN kind = 'error' THEN 0 WHEN packet THEN size + bytes ELSE size END,
    CASE WHEN packet AND n = 0 THEN us ELSE opened END,
    CASE WHEN kind = 'error' THEN 0 WHEN new_rate > 0 AND n = 0 THEN new_rate ELSE rate END,
    CASE WHEN kind = 'error' THEN 0 WHEN new_rate > 0 THEN new_rate ELSE nxt END,
    rolled, CASE WHEN kind = 'error' THEN [CASE WHEN n > 0 THEN opened ELSE us END, us, n, size, rate] END
  FROM (SELECT p.id, p.r, p.us, p.kind, p.bytes, p.new_rate, p.kind IN ('view', 'click', 'purchase') AS packet, w.nxt,
     CASE WHEN roll THEN 0 ELSE w.n END AS n, CASE WHEN roll THEN 0 ELSE w.size END AS size, w.opened,
     CASE WHEN roll THEN w.nxt ELSE w.rate END AS rate,
     CASE WHEN roll THEN [w.opened, w.opened + 86400000000, w.n, w.size, w.rate] END AS rolled
   FROM walk w JOIN p ON p.id = w.id AND p.r = w.r + 1, LATERAL (SELECT w.n > 0 AND p.us - w.opened >= 86400000000 AS roll))),
ends AS (SELECT w.* FROM walk w JOIN (SELECT id, max(r) AS r FROM p GROUP BY id) m ON m.id = w.id AND m.r = w.r),
closed AS (
  SELECT id, rolled AS c, 'rollover' AS closed_by FROM walk WHERE rolled IS NOT NULL
  UNION ALL SELECT id, stopped, 'stop' FROM walk WHERE stopped IS NOT NULL
  UNION ALL SELECT id, [opened, opened + 86400000000, n, size, rate], 'rollover' FROM ends WHERE n > 0 AND opened + 86400000000 <= (SELECT max(us) FROM p)),
segments_ AS (SELECT id AS connection_id, c[1] AS started_us, c[2] AS ended_us, c[3] AS n_packets, c[4] AS bytes, c[5] AS rate, closed_by FROM closed)"""


def last_instant(spark, d) -> int:
    return given(spark, d, "events").agg(F.max(F.unix_micros("ts"))).first()[0]


@query(
    "rollover_segments",
    b.with_cte("activity", recursive=True) + "," + SQL_ROLLOVER + " SELECT * FROM segments_",
)
def rollover_segments(spark, d):
    return ro.closed_segments(packets(given(spark, d, "events")), INTERVAL_S, last_instant(spark, d))


@query(
    "live_rollover_segments",
    b.with_cte("activity", recursive=True) + "," + SQL_ROLLOVER + " SELECT * FROM segments_",
)
def live_rollover_segments(spark, d):
    stream = ro.live_segments(packets(live.given_stream(spark, d, "events")), INTERVAL_S, "0 seconds")
    return live.drained(stream, "rollover")


@query(
    "captured_sessions",
    b.with_cte("activity", recursive=True)
    + ","
    + SQL_ROLLOVER
    + """
SELECT connection_id, strftime(make_timestamp(started_us), '%Y-%m-%d %H:%M:%S') AS started_at, round((ended_us - started_us) / 1e6, 6) AS duration_s,
       bytes AS bytes_written, rate AS sample_rate_hz, CASE WHEN n_packets = 0 THEN 'silent' ELSE 'pending_vad' END AS status FROM segments_""",
)
def captured_sessions(spark, d):
    rows = ro.as_sessions(ro.closed_segments(packets(given(spark, d, "events")), INTERVAL_S, last_instant(spark, d)))
    return rows.select(
        "connection_id", b.stamp("started_at").alias("started_at"), b.r6("duration_s").alias("duration_s"),
        "bytes_written", "sample_rate_hz", "status",
    )


@query(
    "live_conversations",
    """
WITH flags AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS o FROM events),
ids AS (SELECT *, SUM(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM flags),
found AS (SELECT user_id, min(ts) AS s, max(ts) AS e, count(*) AS n FROM ids GROUP BY user_id, g)
SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(e, '%Y-%m-%d %H:%M:%S') AS ended_at, n AS n_events
FROM found WHERE e + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events)""",
)
def live_conversations(spark, d):
    stream = live.live_conversations(live.given_stream(spark, d, "events"), "12 hours")
    rows = live.drained(stream, "sessions")
    return rows.select("user_id", b.stamp("started_at").alias("started_at"), b.stamp("ended_at").alias("ended_at"), "n_events")


@query(
    "live_linked_speakers",
    b.with_cte("clusters", recursive=True)
    + ","
    + SQL_ORDERED
    + """
SELECT user_id, cluster_id, speaker_id, is_new, CAST(mention_count AS INTEGER) AS mention_count FROM fold
WHERE r > 0 AND cluster_id < (SELECT max(cluster_id) FROM clusters) - 30""",
)
def live_linked_speakers(spark, d):
    """Clusters arrive a second apart; those behind the watermark, half a minute back, are linked."""
    rows = b.clustered(live.given_stream(spark, d, "embeddings"))
    arriving = rows.withColumn("ts", F.timestamp_seconds(F.col("cluster_id") + 86400))
    with voices.keyed_state(spark):
        links = live.drained(voices.live_links(arriving, 0.2, "30 seconds"), "links")
    return links.select("user_id", "cluster_id", "speaker_id", "is_new", "mention_count")


@query(
    "live_trigger_matches",
    "WITH RECURSIVE " + SQL_MATCHES + " SELECT id, phrase AS matched_phrase, transcript AS input_text FROM matches",
)
def live_trigger_matches(spark, d):
    texts = live.given_stream(spark, d, "conversations").select(
        F.lit("me").alias("user_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("conversation_id"), "text"
    )
    rows = live.drained(live.live_invocations(texts, action(spark)), "triggers")
    return rows.select(F.col("conversation_id").alias("id"), "matched_phrase", "input_text")


def transcribe(waiting):
    """Stand-in for a model call: some sessions fail."""
    return waiting.select("id", F.when(F.col("id") % 5 == 0, F.lit("no speech")).alias("error_msg"))


@query(
    "advanced_stage",
    b.with_cte("sessions")
    + """
SELECT id, CASE WHEN status = 'pending_stt' THEN CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'pending_llm' END ELSE status END AS status,
       CASE WHEN status = 'pending_stt' THEN CASE WHEN id % 5 = 0 THEN 'no speech' END ELSE error_msg END AS error_msg FROM sessions""",
)
def advanced_stage(spark, d):
    return live.stage_step("stt", b.sessions(spark, d), transcribe)[0].select("id", "status", "error_msg")


@query(
    "dead_letters",
    b.with_cte("sessions") + " SELECT id, 'no speech' AS error_msg FROM sessions WHERE status = 'pending_stt' AND id % 5 = 0",
)
def dead_letters(spark, d):
    return live.stage_step("stt", b.sessions(spark, d), transcribe)[1].select("id", "error_msg")


@query(
    "fallback_backend",
    "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'label' ELSE 'text' END AS backend FROM documents",
)
def fallback_backend(spark, d):
    primary = given(spark, d, "labels").select("doc_id", F.lit("label").alias("backend"))
    fallback = given(spark, d, "documents").select("doc_id", F.lit("text").alias("backend"))
    return live.first_usable(primary, fallback, ["doc_id"])
