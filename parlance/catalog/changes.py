"""Queries: new versions of archive tables after changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.operators.rows import descendants
from parlance.plans import changes as ch


@query(
    "rated_conversations",
    b.with_cte("conv")
    + """
SELECT id, CASE id % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 WHEN 2 THEN NULL ELSE quality_override END AS quality_override FROM conv""",
)
def rated_conversations(spark, d):
    conv = b.conv(spark, d)
    kinds = F.array(*[F.lit(x) for x in ("noise", "substantive", "clear", "nonsense")])
    ratings = conv.filter("id % 5 < 4").select("id", F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")).alias("rating"))
    return ch.rated(conv, ratings).select("id", "quality_override")


@query(
    "renamed_speakers",
    b.with_cte("clusters", "voices")
    + " SELECT id, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'New ' || id ELSE name END AS name FROM voices",
)
def renamed_speakers(spark, d):
    known = b.voices(spark, d)
    name = F.when(F.col("id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" New "), F.col("id").cast("string"), F.lit(" ")))
    return ch.renamed(known, known.filter("id % 3 < 2").select("id", name.alias("name"))).select("id", "name")


@query(
    "toggled_archived",
    b.with_cte("sessions") + " SELECT id, CASE WHEN id % 4 = 0 THEN NOT archived ELSE archived END AS archived FROM sessions",
)
def toggled_archived(spark, d):
    rows = b.sessions(spark, d)
    return ch.toggled(rows, rows.filter("id % 4 = 0"), "archived").select("id", "archived")


@query(
    "action_status_changes",
    b.with_cte("tasks")
    + """
SELECT id, CASE WHEN id % 10 = 0 THEN 'done' ELSE status END AS status, false AS refused FROM tasks
UNION ALL SELECT id, 'later', true FROM tasks WHERE id % 10 = 1""",
)
def action_status_changes(spark, d):
    rows = b.tasks(spark, d)
    wanted = rows.filter("id % 10 < 2").select("id", F.when(F.col("id") % 10 == 0, "done").otherwise("later").alias("status"))
    new, refused = ch.with_action_status(rows, wanted)
    return new.select("id", "status", F.lit(False).alias("refused")).unionByName(refused.withColumn("refused", F.lit(True)))


@query(
    "stage_outcomes",
    b.with_cte("sessions")
    + """
SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' ELSE status END AS status,
       CASE WHEN id % 3 = 0 THEN substr(repeat('x' || id, 200), 1, 500) ELSE error_msg END AS error_msg FROM sessions""",
)
def stage_outcomes(spark, d):
    rows = b.sessions(spark, d)
    failed = rows.filter("id % 3 = 0").select(
        "id",
        F.lit("failed").alias("status"),
        F.repeat(F.concat(F.lit("x"), F.col("id").cast("string")), F.lit(200)).alias("error_msg"),
    )
    return ch.with_status(rows, failed).select("id", "status", "error_msg")


@query(
    "exported_events",
    b.with_cte("activity", "cal")
    + " SELECT id, exported_to_ics OR (id % 2 = 0 AND starts_at IS NOT NULL) AS exported_to_ics FROM cal",
)
def exported_events(spark, d):
    rows = b.cal(spark, d)
    return ch.exported(rows, rows.filter("id % 2 = 0")).select("id", "exported_to_ics")


SQL_TREE = """
tree AS (SELECT id FROM sessions WHERE user_id = 'u7'
         UNION SELECT s.id FROM sessions s JOIN tree t ON s.parent_id = t.id)"""


@query(
    "session_tree",
    b.with_cte("sessions", recursive=True) + "," + SQL_TREE + " SELECT id FROM tree",
)
def session_tree(spark, d):
    rows = b.sessions(spark, d)
    return descendants(rows, rows.filter("user_id = 'u7'"))


def tables(spark, d):
    return {
        "audio_sessions": b.sessions(spark, d),
        "transcripts": b.versions(spark, d),
        "conversations": b.conv(spark, d),
        "calendar_events": b.cal(spark, d),
        "action_items": b.tasks(spark, d),
        "decisions": b.decided(spark, d),
        "people_mentions": b.mentions(spark, d),
        "wake_invocations": b.fired(spark, d),
    }


SQL_TABLES = {
    "audio_sessions": "sessions", "transcripts": "versions", "conversations": "conv", "calendar_events": "cal",
    "action_items": "tasks", "decisions": "decided", "people_mentions": "mentions", "wake_invocations": "fired",
}


def counted(found):
    """Rows left per table, with a checksum of their ids: their sum, beyond the range of a long modulo 2^64."""
    out = None
    half, whole = (F.lit(str(x)).cast("decimal(20,0)") for x in (2**63, 2**64))
    for name, df in found.items():
        # ids of a large table add up to more than a long; the sum itself is exact in a decimal
        total = F.coalesce(F.sum(F.col("id").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
        checksum = (F.pmod(total + half, whole) - half).cast("long")
        part = df.agg(F.count("*").alias("n"), checksum.alias("id_sum")).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sql_counted(session_gone: str, conversation_gone: str) -> str:
    parts = []
    for name, cte in SQL_TABLES.items():
        column, gone = {
            "audio_sessions": ("id", session_gone),
            "transcripts": ("audio_session_id", session_gone),
            "conversations": ("id", conversation_gone),
        }.get(name, ("conversation_id", conversation_gone))
        parts.append(
            f"SELECT '{name}' AS name, count(*) AS n, CAST(COALESCE(sum(id), 0) AS BIGINT) AS id_sum FROM {cte} "
            f"WHERE {column} NOT IN (SELECT id FROM {gone})"
        )
    return " UNION ALL ".join(parts)


ALL_CTES = ("activity", "sessions", "versions", "conv", "cal", "tasks", "decided", "mentions", "fired")


@query(
    "deleted_conversations",
    b.with_cte(*ALL_CTES)
    + ", gone AS (SELECT id FROM conv WHERE id % 3 = 0), owners AS (SELECT audio_session_id AS id FROM conv WHERE id % 3 = 0) "
    + sql_counted("owners", "gone"),
)
def deleted_conversations(spark, d):
    found = tables(spark, d)
    return counted(ch.without_conversations(found, found["conversations"].filter("id % 3 = 0")))


@query(
    "dismissed_sessions",
    b.with_cte(*ALL_CTES, recursive=True)
    + ","
    + SQL_TREE
    + ", gone AS (SELECT id FROM conv WHERE audio_session_id IN (SELECT id FROM tree)) "
    + sql_counted("tree", "gone")
    + " UNION ALL SELECT 'audio_paths', count(*), CAST(sum(id) AS BIGINT) FROM sessions WHERE id IN (SELECT id FROM tree) AND audio_path IS NOT NULL",
)
def dismissed_sessions(spark, d):
    found = tables(spark, d)
    left, paths = ch.without_sessions(found, found["audio_sessions"].filter("user_id = 'u7'"))
    return counted({**left, "audio_paths": paths})


@query(
    "deleted_actions",
    b.with_cte("activity", "actions", "fired")
    + """
SELECT 'action' AS kind, id FROM actions WHERE id % 2 = 1
UNION ALL SELECT 'invocation', id FROM fired WHERE wake_action_id NOT IN (SELECT id FROM actions WHERE id % 2 = 0)""",
)
def deleted_actions(spark, d):
    actions = b.actions(spark, d)
    left, log = ch.without_actions(actions, b.fired(spark, d), actions.filter("id % 2 = 0"))
    return left.select(F.lit("action").alias("kind"), "id").unionByName(log.select(F.lit("invocation").alias("kind"), "id"))


@query(
    "swept_sessions",
    b.with_cte("sessions")
    + """
SELECT id, CASE WHEN NOT archived AND audio_path LIKE '/audio/%' AND status IN ('done', 'segmented')
   AND started_at < TIMESTAMP '2000-01-31 00:00:00' - INTERVAL 30 DAY THEN NULL ELSE audio_path END AS audio_path FROM sessions""",
)
def swept_sessions(spark, d):
    return ch.swept(b.sessions(spark, d), "2000-01-31 00:00:00", 30, "/audio/").select("id", "audio_path")


@query(
    "replayed_sessions",
    b.with_cte("sessions", "versions")
    + """
SELECT s.id, CASE WHEN s.status <> 'failed' THEN s.status
   WHEN s.parent_id IS NULL THEN 'pending_vad'
   WHEN EXISTS (SELECT 1 FROM versions v WHERE v.audio_session_id = s.id) THEN 'pending_llm' ELSE 'pending_stt' END AS status,
   CASE WHEN s.status <> 'failed' THEN error_msg END AS error_msg FROM sessions s""",
)
def replayed_sessions(spark, d):
    rows = b.sessions(spark, d)
    stages = ch.replay_stage(rows.filter("status = 'failed'"), b.versions(spark, d))
    return ch.replayed(rows, stages).select("id", "status", "error_msg")
