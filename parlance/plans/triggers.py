"""Trigger phrases: matches in transcripts and the invocation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import shell_quoted
from parlance.operators.phrases import phrase_matches


def decoded_actions(actions: DataFrame) -> DataFrame:
    """Actions whose phrase lists arrive as JSON text.

    A malformed phrase list drops the action; a malformed stop list counts as empty.
    """
    as_list = lambda c: F.from_json(F.col(c), "ARRAY<STRING>", {"mode": "PERMISSIVE"})
    return actions.withColumns(
        {"phrases": as_list("phrases_json"), "stop_phrases": F.coalesce(as_list("stop_phrases_json"), F.array().cast("array<string>"))}
    ).filter(F.col("phrases").isNotNull())


def resolved(template: Column, variables: dict[str, Column]) -> Column:
    """The command with ``$name`` and ``${name}`` replaced by shell-safe values.

    Unknown names stay, ``$$`` is a dollar sign.  The template is cut at its dollar signs and
    each piece is resolved on its own, so replaced values are never looked at again.
    """
    quoted = F.create_map(*[x for name, value in variables.items() for x in (F.lit(name), shell_quoted(value))])
    piece = r"\$\$|\$\{[_A-Za-z][_A-Za-z0-9]*\}|\$[_A-Za-z][_A-Za-z0-9]*|[^$]+|\$"
    name = lambda p: F.regexp_extract(p, r"^\$\{?([_A-Za-z][_A-Za-z0-9]*)\}?$", 1)
    one = lambda p: (
        F.when(p == "$$", F.lit("$"))
        .when(p.startswith("$"), F.coalesce(F.try_element_at(quoted, name(p)), p))
        .otherwise(p)
    )
    return F.array_join(F.transform(F.regexp_extract_all(template, F.lit(piece), F.lit(0)), one), "")


def matched(texts: DataFrame, actions: DataFrame) -> DataFrame:
    """Matches of each user's enabled actions: one row per accepted hit.

    ``texts``: ``user_id, conversation_id, text``; ``actions``: ``id, user_id, phrases,
    stop_phrases, command, enabled``. A user's actions (a settings list) meet each text once.
    """
    no_words = F.array().cast("array<string>")
    listed = F.struct("id", F.coalesce("phrases", no_words).alias("phrases"), F.coalesce("stop_phrases", no_words).alias("stop_phrases"), "command")
    live = actions.filter("enabled").groupBy("user_id").agg(F.array_sort(F.collect_list(listed)).alias("actions"))
    found = texts.join(live, "user_id").withColumn("matches", phrase_matches(F.col("text"), F.col("actions.phrases"), F.col("actions.stop_phrases")))
    rows = found.select("user_id", "conversation_id", "text", "actions", F.explode("matches").alias("m"))
    action = F.get("actions", F.col("m.action"))
    return rows.select(
        "user_id", action["id"].alias("wake_action_id"), "conversation_id", "m.nth", "m.phrase", "m.start", "m.end", "m.transcript",
        "text", action["command"].alias("command"),
    )


def invocations(texts: DataFrame, actions: DataFrame) -> DataFrame:
    """The invocation log: matched phrase, its slice and the resolved command."""
    variables = {
        "transcript": F.col("transcript"),
        "transcript_full": F.col("text"),
        "conversation_id": F.coalesce(F.col("conversation_id").cast("string"), F.lit("")),
        "wake_phrase": F.col("phrase"),
    }
    return matched(texts, actions).select(
        "user_id",
        "wake_action_id",
        "conversation_id",
        "nth",
        "start",
        F.col("phrase").alias("matched_phrase"),
        F.col("transcript").alias("input_text"),
        resolved(F.col("command"), variables).alias("command_resolved"),
    )
