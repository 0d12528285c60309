"""Changes to archive tables.

Plain Parquet has no MERGE: each function returns the new version of the table, and the
caller writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import cap, phrase_list, string_or_null
from parlance.functions.values import clamp
from parlance.operators.rows import descendants, updated, without
from parlance.plans.archive import ACTION_STATUSES, retention_candidates

# What a rating sets.
RATINGS = {"noise": 0.0, "substantive": 1.0, "clear": None}
CHILD_TABLES = ("calendar_events", "action_items", "decisions", "people_mentions", "wake_invocations")
ERROR_LIMIT = 500


def rated(conversations: DataFrame, ratings: DataFrame) -> DataFrame:
    """Apply ratings (``id, rating``); unknown ratings are ignored."""
    override = F.when(F.col("rating") == "noise", F.lit(0.0)).when(F.col("rating") == "substantive", F.lit(1.0))
    known = ratings.filter(F.col("rating").isin(*RATINGS)).select("id", override.alias("quality_override"))
    return updated(conversations, known, "id", ["quality_override"])


def renamed(speakers: DataFrame, names: DataFrame) -> DataFrame:
    """Apply new names (``id, name``); a blank name clears it."""
    return updated(speakers, names.withColumn("name", string_or_null(F.col("name"))), "id", ["name"])


def toggled(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Flip a flag (``is_user``, ``archived``) on the listed rows."""
    hits = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    flipped = F.when(F.col("__hit"), ~F.col(column)).otherwise(F.col(column))
    return df.join(hits, "id", "left").withColumn(column, flipped).select(*df.columns)


def with_action_status(actions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions after status changes (``id, status``), and the refused changes."""
    valid = F.col("status").isin(*ACTION_STATUSES)
    return updated(actions, wanted.filter(valid), "id", ["status"]), wanted.filter(~valid)


def with_status(sessions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sessions after a stage: ``id, status, error_msg``; the message is cut at 500 characters."""
    rows = outcomes.withColumn("error_msg", cap(F.col("error_msg"), ERROR_LIMIT))
    return updated(sessions, rows, "id", ["status", "error_msg"])


def exported(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark exported events; those without a start cannot be exported."""
    hits = ids.select("id").distinct().withColumn("__hit", F.col("id").isNotNull())
    done = F.coalesce("__hit", F.lit(False)) & F.col("starts_at").isNotNull()
    return events.join(hits, "id", "left").withColumn("exported_to_ics", F.col("exported_to_ics") | done).select(*events.columns)


def checked_actions(requests: DataFrame) -> DataFrame:
    """Trigger actions from form rows: lists parsed, names trimmed, timeout within 1..300 s.

    Rows without a name, a command or a phrase are dropped.
    """
    phrases, stops = phrase_list(F.col("phrases")), phrase_list(F.coalesce("stop_phrases", F.lit("")))
    return (
        requests.withColumns(
            {
                "name": string_or_null(F.col("name")),
                "phrases": phrases,
                "stop_phrases": F.when(F.size(stops) > 0, stops),
                "timeout_seconds": clamp(F.col("timeout_seconds"), 1.0, 300.0),
            }
        )
        .filter(F.col("name").isNotNull() & string_or_null(F.col("command")).isNotNull() & (F.size("phrases") > 0))
    )


def without_actions(actions: DataFrame, invocations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions and invocations after deleting actions."""
    return without(actions, ids, "id"), without(invocations, ids, "wake_action_id")


def without_conversations(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting conversations with their dependents and their sessions.

    Decisions go with their conversation, like the other dependents.
    """
    owners = tables["conversations"].join(ids.select("id"), "id", "left_semi").select(F.col("audio_session_id").alias("id"))
    out = dict(tables)
    for name in CHILD_TABLES:
        out[name] = without(tables[name], ids, "conversation_id")
    out["conversations"] = without(tables["conversations"], ids, "id")
    out["transcripts"] = without(tables["transcripts"], owners, "audio_session_id")
    out["audio_sessions"] = without(tables["audio_sessions"], owners, "id")
    return out


def without_sessions(tables: dict[str, DataFrame], roots: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables after dismissing sessions with everything below them; and the audio paths freed."""
    gone = descendants(tables["audio_sessions"], roots)
    conversations = tables["conversations"].join(gone.select(F.col("id").alias("audio_session_id")), "audio_session_id", "left_semi")
    ids = conversations.select("id")
    out = dict(tables)
    for name in CHILD_TABLES:
        out[name] = without(tables[name], ids, "conversation_id")
    out["conversations"] = without(tables["conversations"], gone, "audio_session_id")
    out["transcripts"] = without(tables["transcripts"], gone, "audio_session_id")
    out["audio_sessions"] = without(tables["audio_sessions"], gone, "id")
    paths = tables["audio_sessions"].join(gone, "id", "left_semi").filter(F.col("audio_path").isNotNull())
    return out, paths.select("id", "audio_path")


def swept(sessions: DataFrame, as_of: str, keep_days: int, root: str) -> DataFrame:
    """Sessions after the retention sweep: expired ones lose their audio path."""
    gone = retention_candidates(sessions, as_of, keep_days, root).select("id", F.lit(None).cast("string").alias("audio_path"))
    return updated(sessions, gone, "id", ["audio_path"])


def replay_stage(sessions: DataFrame, transcripts: DataFrame, vad_enabled: bool = True) -> DataFrame:
    """The stage each session would be replayed from: ``id, stage``."""
    has = transcripts.select(F.col("audio_session_id").alias("id")).distinct().withColumn("__has", F.lit(True))
    raw = F.col("parent_id").isNull() & F.col("status").isin("recording", "failed") & F.lit(vad_enabled)
    stage = (
        F.when(F.col("status").isin("segmented", "pending_vad") | raw, "vad")
        .when(F.col("__has"), "llm")
        .otherwise("stt")
    )
    return sessions.join(has, "id", "left").select("id", stage.alias("stage"))


def replayed(sessions: DataFrame, stages: DataFrame) -> DataFrame:
    """Sessions reset to the start of a stage, errors cleared."""
    rows = stages.select("id", F.concat(F.lit("pending_"), "stage").alias("status"), F.lit(None).cast("string").alias("error_msg"))
    return updated(sessions, rows, "id", ["status", "error_msg"])
