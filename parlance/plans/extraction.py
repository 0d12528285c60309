"""Model answers to archive rows, and the messages sent to models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.answers import answer_object, objects_at, plain_at, strings_at, text_at
from parlance.functions.text import cap, string_or_null
from parlance.functions.values import confidence, iso_timestamp, score_or_null
from parlance.plans.transcripts import RENDER_BUDGET
from parlance.session import settle, spread

TITLE_LIMIT = 200
CATEGORIES = ("topics", "calendar_events", "action_items", "decisions", "people_mentioned")
NO_OBJECT = "answer holds no JSON object"
NO_TEXT = "response holds no text"
NO_NARRATIVE = "answer holds no narrative"


def parsed(responses: DataFrame) -> DataFrame:
    """Answers (``session_id, raw``) with their object: ``object, repaired, error``.

    Rows without an object keep flowing, marked with an error.
    """
    found, repaired = answer_object(F.col("raw"))
    return responses.withColumns({"object": found, "repaired": repaired}).withColumn(
        "error", F.when(F.try_parse_json("object").isNull(), F.lit(NO_OBJECT))
    )


def quality(score: Column, repaired: Column) -> Column:
    """The stored score: 0.5 without one, a tenth less for a mended answer."""
    base = F.coalesce(score, F.lit(0.5))
    return F.when(repaired, F.greatest(F.lit(0.0), base - 0.1)).otherwise(base)


def ingested(responses: DataFrame, enabled: dict[str, bool] | None = None) -> dict[str, DataFrame]:
    """Answers to ``conversations``, the child tables and ``failed``.

    ``responses``: ``session_id, user_id, started_at, ended_at, raw``.  The conversation of a
    session has the session's id.  Disabled categories yield no rows.
    """
    on = {c: True for c in CATEGORIES} | (enabled or {})
    # Finding the object is the costly part; it runs once, over all tasks.
    rows = settle(parsed(spread(responses)).drop("raw"), "answers")
    good = rows.filter(F.col("error").isNull()).withColumn("v", F.try_parse_json("object"))
    v = F.col("v")
    topics = strings_at(v, "$.topics")
    conversations = good.select(
        F.col("session_id").alias("id"),
        F.col("session_id").alias("audio_session_id"),
        "user_id",
        text_at(v, "$.title").alias("title"),
        text_at(v, "$.summary").alias("summary"),
        (F.when(F.size(topics) > 0, topics) if on["topics"] else F.lit(None).cast("array<string>")).alias("topics"),
        F.col("repaired").alias("extraction_repaired"),
        quality(score_or_null(plain_at(v, "$.quality_score")), F.col("repaired")).alias("quality_score"),
        text_at(v, "$.quality_reasoning").alias("quality_reasoning"),
        "started_at",
        F.coalesce("ended_at", "started_at").alias("ended_at"),
    )

    def items(category: str) -> DataFrame:
        source = good if on[category] else good.limit(0)
        return source.select(
            F.col("session_id").alias("conversation_id"),
            "started_at",
            F.posexplode(objects_at(v, f"$.{category}")).alias("nth", "i"),
        )

    i = F.col("i")
    strings = lambda path: F.when(F.size(strings_at(i, path)) > 0, strings_at(i, path))
    events = items("calendar_events").select(
        "conversation_id",
        "nth",
        F.coalesce(F.nullif(cap(plain_at(i, "$.title"), TITLE_LIMIT), F.lit("")), F.lit("(untitled)")).alias("title"),
        plain_at(i, "$.description").alias("description"),
        iso_timestamp(plain_at(i, "$.starts_at")).alias("starts_at"),
        iso_timestamp(plain_at(i, "$.ends_at")).alias("ends_at"),
        plain_at(i, "$.location").alias("location"),
        strings("$.attendees").alias("attendees"),
        confidence(plain_at(i, "$.confidence")).alias("confidence"),
    )
    actions = items("action_items").select(
        "conversation_id",
        "nth",
        string_or_null(plain_at(i, "$.text")).alias("text"),
        plain_at(i, "$.owner").alias("owner"),
        iso_timestamp(plain_at(i, "$.due_at")).alias("due_at"),
        F.lit("open").alias("status"),
    ).filter(F.col("text").isNotNull())
    decisions = items("decisions").select(
        "conversation_id",
        "nth",
        string_or_null(plain_at(i, "$.text")).alias("text"),
        plain_at(i, "$.made_by").alias("made_by"),
        confidence(plain_at(i, "$.confidence")).alias("confidence"),
    ).filter(F.col("text").isNotNull())
    people = items("people_mentioned").select(
        "conversation_id",
        "nth",
        string_or_null(plain_at(i, "$.name")).alias("name"),
        plain_at(i, "$.context").alias("context"),
        F.col("started_at").alias("mentioned_at"),
    ).filter(F.col("name").isNotNull())
    return {
        "conversations": conversations,
        "calendar_events": events,
        "action_items": actions,
        "decisions": decisions,
        "people_mentions": people,
        "failed": rows.filter(F.col("error").isNotNull()).select("session_id", "error"),
    }


def narratives(answers: DataFrame) -> DataFrame:
    """Day narratives (``user_id, date, raw``); without a non-blank one the row has an error."""
    found, _ = answer_object(F.col("raw"))
    told = text_at(F.try_parse_json(found), "$.narrative")
    return answers.withColumn("narrative", told).withColumn(
        "error", F.when(F.col("narrative").isNull(), F.lit(NO_NARRATIVE))
    ).drop("raw")


def transcribed(responses: DataFrame) -> DataFrame:
    """Transcription responses (``session_id, raw``): text, segments, language, error."""
    v = F.try_parse_json("raw")
    text = string_or_null(plain_at(v, "$.text"))
    segment = "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING>>"
    return responses.select(
        "session_id",
        text.alias("text"),
        F.coalesce(F.try_variant_get(v, "$.segments", segment), F.array().cast(segment)).alias("segments"),
        F.coalesce(
            F.nullif(plain_at(v, "$.language"), F.lit("")), plain_at(v, "$.detected_language")
        ).alias("language"),
        F.when(text.isNull(), F.lit(NO_TEXT)).alias("error"),
    )


def chat_answers(responses: DataFrame) -> DataFrame:
    """Chat envelopes (``session_id, raw``): content of the first choice, finish reason, error."""
    v = F.try_parse_json("raw")
    content = plain_at(v, "$.choices[0].message.content")
    return responses.select(
        "session_id",
        content.alias("content"),
        plain_at(v, "$.choices[0].finish_reason").alias("finish_reason"),
        F.when(string_or_null(content).isNull(), F.lit(NO_TEXT)).alias("error"),
    )


def messages(sessions: DataFrame, rendered: DataFrame, system: str, zone: str = "UTC", budget: int = RENDER_BUDGET) -> DataFrame:
    """Message rows per session and part: ``session_id, part, nth, role, content``.

    ``sessions``: ``session_id, started_at, text``; ``rendered``: ``session_id, body`` and, of ``rendered_parts``, ``part``.
    Without a rendered body the plain text is used, in parts of ``budget`` characters.
    """
    part = F.col("part") if "part" in rendered.columns else F.lit(0).alias("part")
    bodies = rendered.filter(F.col("body") != "").select("session_id", part, "body")
    text = F.coalesce("text", F.lit(""))
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(budget))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * budget + 1, F.lit(budget)))
    plain = sessions.join(bodies.select("session_id").distinct(), "session_id", "left_anti").select("session_id", F.posexplode(pieces).alias("part", "body"))
    joined = sessions.select("session_id", "started_at").join(bodies.unionByName(plain), "session_id")
    body = F.col("body")
    user = F.concat(
        F.lit("Date: "), F.date_format(F.from_utc_timestamp("started_at", zone), "yyyy-MM-dd HH:mm"),
        F.lit(f" ({zone}).\n\nTranscript:\n"), body, F.lit("\n"),
    )
    pair = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    return joined.select("session_id", "part", F.posexplode(pair).alias("nth", "m")).select("session_id", "part", "nth", "m.*")


def through_model(
    df: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, tasks: int | None = None
) -> DataFrame:
    """Run a model over batches of rows; the model is loaded once per task."""
    spread = df.repartition(tasks) if tasks else df
    return spread.mapInPandas(model, schema)
