"""List, detail and dashboard queries over the archive tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import strip
from parlance.operators.rows import first_k, newest

# Named quality thresholds and page sizes.
THRESHOLDS = {"all": 0.0, "normal": 0.3, "substantive": 0.7}
INDEX_FETCH, INDEX_SHOWN = 200, 100
IN_PROGRESS = ("pending_vad", "pending_stt", "pending_llm", "failed")
ACTION_STATUSES = ("open", "done", "dismissed")


def effective_quality() -> Column:
    return F.coalesce("quality_override", "quality_score")


def threshold(name: str | None = None, show_hidden: bool = False) -> float:
    return 0.0 if show_hidden else THRESHOLDS.get(name or "normal", THRESHOLDS["normal"])


def quality_bucket(quality: Column) -> Column:
    return (
        F.when(quality < THRESHOLDS["normal"], "noise")
        .when(quality < THRESHOLDS["substantive"], "normal")
        .otherwise("substantive")
    )


def of_user(df: DataFrame, user: str | None) -> DataFrame:
    return df if user is None else df.filter(F.col("user_id") == user)


def with_conversation(children: DataFrame, conversations: DataFrame, user: str | None = None) -> DataFrame:
    """Child rows (events, actions, mentions) with the title and owner of their conversation."""
    owner = of_user(conversations, user).select(
        F.col("id").alias("conversation_id"), "user_id", F.col("title").alias("conversation_title")
    )
    return children.join(owner, "conversation_id")


def conversation_list(conversations: DataFrame, user: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return of_user(conversations, user).orderBy(F.desc("started_at"), "id").offset(offset).limit(limit)


def index_candidates(conversations: DataFrame, user: str | None, fetch: int = INDEX_FETCH) -> DataFrame:
    """The newest ``fetch`` conversations; the quality filter comes after this cut."""
    return (
        of_user(conversations, user)
        .orderBy(F.desc("started_at"), "id")
        .limit(fetch)
        .withColumn("quality", effective_quality())
    )


def child_counts(events: DataFrame, actions: DataFrame, conversations: DataFrame) -> DataFrame:
    """Number of events and of open actions per conversation; zero where there is none."""
    n = lambda df, name: df.groupBy("conversation_id").agg(F.count("*").alias(name))
    keyed = conversations.select(F.col("id").alias("conversation_id"))
    return (
        keyed.join(n(events, "n_events"), "conversation_id", "left")
        .join(n(actions.filter(F.col("status") == "open"), "n_open_actions"), "conversation_id", "left")
        .select(
            F.col("conversation_id").alias("id"),
            F.coalesce("n_events", F.lit(0)).alias("n_events"),
            F.coalesce("n_open_actions", F.lit(0)).alias("n_open_actions"),
        )
    )


def index_page(
    conversations: DataFrame, events: DataFrame, actions: DataFrame, user: str, quality: str | None = None,
    show_hidden: bool = False, fetch: int = INDEX_FETCH, shown: int = INDEX_SHOWN,
) -> DataFrame:
    """Cards of the index page: the newest ``fetch``, filtered by quality, at most ``shown``."""
    least = threshold(quality, show_hidden)
    kept = index_candidates(conversations, user, fetch).filter(F.col("quality") >= least)
    kept = kept.orderBy(F.desc("started_at"), "id").limit(shown)
    # The counts are needed for the shown conversations only.
    mine = lambda df: df.join(kept.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    return kept.join(child_counts(mine(events), mine(actions), kept), "id").select(
        "id",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        "started_at",
        "quality",
        quality_bucket(F.col("quality")).alias("bucket"),
        "n_events",
        "n_open_actions",
    )


def hidden_count(conversations: DataFrame, user: str | None, quality: str | None = None, show_hidden: bool = False) -> DataFrame:
    least = threshold(quality, show_hidden)
    return index_candidates(conversations, user).agg(F.count_if(F.col("quality") < least).alias("hidden"))


def event_list(
    events: DataFrame, conversations: DataFrame, user: str | None, as_of: str, upcoming: bool = True,
    min_confidence: float = 0.0, limit: int = 100,
) -> DataFrame:
    rows = events.filter(F.col("confidence") >= min_confidence)
    if upcoming:
        rows = rows.filter(F.col("starts_at") >= F.lit(as_of).cast("timestamp"))
    joined = with_conversation(rows, conversations, user)
    return joined.orderBy(F.asc_nulls_last("starts_at"), "id").limit(limit)


def events_page(
    events: DataFrame, conversations: DataFrame, user: str | None, as_of: str, ahead_rows: int | None = 100, past_rows: int | None = 20
) -> DataFrame:
    """The next events and the last ones, up to a page of each (None: all); events without a start are in neither."""
    page = lambda rows, size: rows if size is None else rows.limit(size)
    now = F.lit(as_of).cast("timestamp")
    joined = with_conversation(events, conversations, user)
    ahead = page(joined.filter(F.col("starts_at") >= now).orderBy("starts_at", "id"), ahead_rows)
    past = page(joined.filter(F.col("starts_at") < now).orderBy(F.desc("starts_at"), "id"), past_rows)
    return ahead.withColumn("part", F.lit("upcoming")).unionByName(past.withColumn("part", F.lit("past")))


def action_list(
    actions: DataFrame, conversations: DataFrame, user: str | None, status: str | None = None, limit: int = 100
) -> DataFrame:
    """Actions by due time; an unknown status means open, ``all`` means every status."""
    rows = actions
    if status != "all":
        rows = rows.filter(F.col("status") == (status if status in ACTION_STATUSES else "open"))
    joined = with_conversation(rows, conversations, user)
    return joined.orderBy(F.asc_nulls_last("due_at"), "id").limit(limit)


def people(
    mentions: DataFrame, conversations: DataFrame, user: str | None = None, limit: int | None = 200,
    recent_rows: int | None = None,
) -> DataFrame:
    """People by number of mentions, with their latest mention; ties go to the later one.

    ``recent_rows`` looks at the newest mentions only; by default all are counted.
    """
    rows = with_conversation(mentions, conversations, user)
    if recent_rows is not None:
        rows = rows.orderBy(F.desc("mentioned_at"), F.desc("id")).limit(recent_rows)
    key = F.lower(strip(F.col("name")))
    latest = F.max_by(
        F.struct("name", "context", "conversation_id", "conversation_title", "mentioned_at"),
        F.struct("mentioned_at", "id"),
    )
    grouped = (
        rows.withColumn("person", key)
        .filter(F.col("person") != "")
        .groupBy("person")
        .agg(F.count("*").alias("mention_count"), latest.alias("latest"))
        .select("person", "mention_count", "latest.*")
    )
    ordered = grouped.orderBy(F.desc("mention_count"), F.desc("mentioned_at"), "person")
    return ordered if limit is None else ordered.limit(limit)


def invocations_of(invocations: DataFrame, actions: DataFrame) -> DataFrame:
    """Trigger invocations with the name of their action."""
    return invocations.join(actions.select(F.col("id").alias("wake_action_id"), F.col("name").alias("action")), "wake_action_id")


def latest_invocations(invocations: DataFrame, k: int = 3) -> DataFrame:
    return first_k(invocations, ["wake_action_id"], [F.desc("created_at"), F.desc("id")], k)


def invocation_log(invocations: DataFrame, action_id, limit: int = 200) -> DataFrame:
    rows = invocations.filter(F.col("wake_action_id") == action_id)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def latest_transcripts(transcripts: DataFrame) -> DataFrame:
    return newest(transcripts, ["audio_session_id"], ["created_at", "id"])


def transcripts_of(transcripts: DataFrame, sessions: DataFrame, user: str | None = None) -> DataFrame:
    owner = of_user(sessions, user).select(F.col("id").alias("audio_session_id"), "user_id")
    return transcripts.join(owner, "audio_session_id")


def detail_rows(
    conversations: DataFrame, transcripts: DataFrame, events: DataFrame, actions: DataFrame, decisions: DataFrame,
    mentions: DataFrame, invocations: DataFrame,
) -> DataFrame:
    """Everything shown for conversations, in long form: ``conversation_id, section, item_id, item``.

    One row per child keeps a conversation with very many children spread out.
    """
    latest = latest_transcripts(transcripts).join(
        conversations.select(F.col("id").alias("conversation_id"), "audio_session_id"), "audio_session_id"
    )
    open_actions = actions.filter(F.col("status") == "open")
    sections = {
        "transcript": (latest, ("text", "language")),
        "event": (events, ("title", "starts_at", "location", "confidence")),
        "action": (open_actions, ("text", "owner", "due_at")),
        "decision": (decisions, ("text",)),
        "person": (mentions, ("name", "context")),
        "invocation": (invocations, ("matched_phrase",)),
    }
    rows = None
    for section, (table, fields) in sections.items():
        part = table.select(
            "conversation_id",
            F.lit(section).alias("section"),
            F.col("id").alias("item_id"),
            F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("item"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")


def conversation_payload(conversations: DataFrame) -> DataFrame:
    """List payload as JSON with ISO times."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    return conversations.select(
        "id", F.to_json(F.struct("id", "title", "summary", iso("started_at"), iso("created_at"))).alias("payload")
    )


def tunable_sessions(sessions: DataFrame, conversations: DataFrame, transcripts: DataFrame, user: str | None, limit: int = 50) -> DataFrame:
    """Newest sessions with audio, their first conversation and whether a transcript exists."""
    rows = of_user(sessions, user).filter(F.col("audio_path").isNotNull()).orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
    keys = rows.select(F.col("id").alias("audio_session_id"))
    mine = lambda df: df.join(keys, "audio_session_id", "left_semi")
    first = mine(conversations).groupBy("audio_session_id").agg(F.min("id").alias("conversation_id"))
    has = mine(transcripts).select("audio_session_id").distinct().withColumn("has_transcript", F.lit(True))
    return (
        rows.withColumn("audio_session_id", F.col("id"))
        .join(first, "audio_session_id", "left")
        .join(has, "audio_session_id", "left")
        .select("id", "started_at", "conversation_id", F.coalesce("has_transcript", F.lit(False)).alias("has_transcript"))
    )


def in_progress(sessions: DataFrame, user: str | None, limit: int = 10) -> DataFrame:
    rows = of_user(sessions, user).filter(F.col("status").isin(*IN_PROGRESS))
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def status_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("status").agg(F.count("*").alias("n"))


def recent_activity(conversations: DataFrame, as_of: str) -> DataFrame:
    """Conversations of the last day and the last one of all, one row."""
    now = F.lit(as_of).cast("timestamp")
    rows = conversations.filter(F.col("created_at") <= now)
    return rows.agg(
        F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 1 DAY")).alias("last_day"),
        F.max_by("id", F.struct("started_at", "id")).alias("last_id"),
        F.max("started_at").alias("last_started_at"),
    )


def recent_failures(sessions: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    rows = sessions.filter(
        (F.col("status") == "failed") & (F.col("started_at") >= now - F.expr("INTERVAL 1 DAY")) & (F.col("started_at") <= now)
    )
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def storage_footprint(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("bytes_written"), F.lit(0)).alias("total_bytes"), F.count("*").alias("n_files"))


def pending(sessions: DataFrame, status: str) -> DataFrame:
    """The queue of one stage, oldest first."""
    return sessions.filter(F.col("status") == status).orderBy("started_at", "id")


def normal_path(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and doubled slashes; ``..`` at the root stays there."""

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def below(path: Column, root: str) -> Column:
    """Whether a path, once normal, lies below the root."""
    return normal_path(path).startswith(posixpath.normpath(root).rstrip("/") + "/")


def speakers_by_mentions(speakers: DataFrame) -> DataFrame:
    """Speakers, the most mentioned first, then the newest."""
    return speakers.orderBy(F.desc("mention_count"), F.desc("created_at"), "id")


def retention_candidates(sessions: DataFrame, as_of: str, keep_days: int, root: str) -> DataFrame:
    """Sessions whose audio may go: processed, not archived, old, stored below the root."""
    if keep_days <= 0:
        return sessions.limit(0)
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(keep_days))
    return sessions.filter(
        ~F.col("archived")
        & below(F.col("audio_path"), root)
        & (F.col("started_at") < cutoff)
        & F.col("status").isin("done", "segmented")
    )


def speech_summary(speech: DataFrame, durations: DataFrame) -> DataFrame:
    """Seconds and percent of speech and silence per session."""
    total = speech.groupBy("session_id").agg(F.sum(F.col("end") - F.col("start")).alias("speech_s"))
    share = F.when(F.col("duration_s") > 0, F.coalesce("speech_s", F.lit(0.0)) / F.col("duration_s") * 100)
    return durations.join(total, "session_id", "left").select(
        "session_id",
        F.coalesce("speech_s", F.lit(0.0)).alias("speech_s"),
        F.coalesce(share, F.lit(0.0)).alias("speech_pct"),
        F.when(F.col("duration_s") > 0, 100 - share).otherwise(F.lit(0.0)).alias("saved_pct"),
    )


def silence_coverage(silences: DataFrame, gap_s: float) -> DataFrame:
    """Number of silences and of those long enough to split, per session."""
    return silences.groupBy("session_id").agg(
        F.count("*").alias("n_silences"), F.count_if(F.col("end") - F.col("start") >= gap_s).alias("n_splits")
    )
