"""Queries: model answers to archive rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.functions import values as fv
from parlance.functions.answers import answer_object
from parlance.functions.text import without_fences, without_thinking
from parlance.plans import extraction as ex
from parlance.plans import transcripts as tr
from parlance.sources.tables import given


def responses(spark, d):
    """Answers built from whole documents, in the shapes that models return them.

    By ``doc_id``: plain, fenced, after reasoning, inside prose, cut off before the last
    brace; every eleventh never ends its reasoning.
    """
    docs = given(spark, d, "documents")
    item = lambda **fields: F.struct(*[c.alias(n) for n, c in fields.items()])
    day = F.date_format(F.lit("2024-01-01").cast("date") + (F.col("doc_id") % 365).cast("int"), "yyyy-MM-dd")
    blank = F.col("doc_id") % 3 == 0
    answer = F.to_json(
        item(
            title=F.concat(F.lit("  "), F.substring_index("text", "\n", 1), F.lit(" ")),
            summary=F.col("text"),
            topics=F.array("lang", "source"),
            quality_score=F.col("n_chars") / F.lit(5000.0),
            calendar_events=F.array(
                item(title=F.col("text"), starts_at=F.concat(day, F.lit("T10:30:00Z")), confidence=F.lit("0.75")),
                item(title=F.when(~blank, F.lit("")).otherwise(F.lit("call")), starts_at=F.lit("tomorrow"), confidence=F.lit("sure")),
            ),
            action_items=F.array(
                item(text=F.concat(F.lit("do "), "source"), owner=F.col("lang"), due_at=F.concat(day, F.lit("T08:00:00+02:00"))),
                item(text=F.when(blank, F.lit("  ")).otherwise(F.lit("again")), owner=F.lit(None).cast("string"), due_at=F.lit(None).cast("string")),
            ),
            decisions=F.array(item(text=F.concat(F.lit("use "), "lang"), made_by=F.col("source"), confidence=F.col("n_chars") / F.lit(100.0))),
            people_mentioned=F.array(item(name=F.concat(F.lit(" "), "source"), context=F.lit("seen"))),
        )
    )
    kind = F.col("doc_id") % 5
    shaped = (
        F.when(kind == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```\n")))
        .when(kind == 2, F.concat(F.lit('<think>maybe {"title": "no"}</think>\n'), answer))
        .when(kind == 3, F.concat(F.lit("Here it is: "), answer, F.lit(" {done}")))
        .when(kind == 4, answer.substr(F.lit(1), F.length(answer) - 1))
        .otherwise(answer)
    )
    return docs.select(
        F.col("doc_id").alias("session_id"),
        F.col("source").alias("user_id"),
        b.minutes_after(b.at("2024-01-01 00:00:00"), F.col("doc_id") * 37).alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("<think>so "), answer)).otherwise(shaped).alias("raw"),
    )


GOOD = "good AS (SELECT *, '2024-01-01'::DATE + CAST(doc_id % 365 AS INTEGER) AS day FROM documents WHERE doc_id % 11 > 0)"


@query(
    "extracted_conversations",
    "WITH "
    + GOOD
    + """
SELECT doc_id AS id, source AS user_id, trim(split_part(text, chr(10), 1)) AS title, length(trim(text, chr(10) || ' ')) AS summary_chars,
  lang || '|' || source AS topics, doc_id % 5 = 4 AS extraction_repaired,
  round(CASE WHEN doc_id % 5 = 4 THEN greatest(0, least(n_chars / 5e3, 1) - 0.1) ELSE least(n_chars / 5e3, 1) END, 6) AS quality_score
FROM good""",
)
def extracted_conversations(spark, d):
    rows = ex.ingested(responses(spark, d))["conversations"]
    return rows.select(
        "id", "user_id", "title", F.length("summary").cast("long").alias("summary_chars"),
        F.array_join("topics", "|").alias("topics"), "extraction_repaired", b.r6("quality_score").alias("quality_score"),
    )


@query(
    "mended_answers",
    """
SELECT doc_id AS id, CASE WHEN doc_id % 7 = 4 THEN 'the "' || source || ' of ' || lang || '" one' ELSE source || ' of ' || lang END AS title,
       length(regexp_replace(text, '[^a-zA-Z0-9 ,.]', ' ', 'g')) AS summary_chars, 0.5e0 AS score, doc_id % 7 < 6 AS repaired FROM documents""",
)
def mended_answers(spark, d):
    """Answers with quotes of other kinds, comments, bare texts, inner quotes and odd numbers, by ``doc_id``; the whole text inside."""
    docs = given(spark, d, "documents")
    title, summary = F.concat("source", F.lit(" of "), "lang"), F.regexp_replace("text", "[^a-zA-Z0-9 ,.]", " ")
    forms = (
        "{'title': '%s', 'summary': '%s', 'score': .5}",
        "{\u201ctitle\u201d: \u201c%s\u201d, \u201csummary\u201d: \u2018%s\u2019, \u201cscore\u201d: 0.5,}",
        '{// found\n"title": "%s", /* all\nof it */ "summary": "%s", "score": +0.5}',
        '{"title": %s, "summary": "%s", "score": 0.5}',
        '{"title": "the "%s" one", "summary": "%s", "score": 0.5}',
        "{'title': '%s' 'summary': '%s', score: 5e-1} // done",
        '{"title": "%s", "summary": "%s", "score": 0.5}',
    )
    raw = F.element_at(F.array(*(F.format_string(form, title, summary) for form in forms)), (F.col("doc_id") % 7 + 1).cast("int"))
    found, repaired = answer_object(raw)
    rows = docs.select("doc_id", found.alias("object"), repaired.alias("repaired"))
    return rows.select(
        F.col("doc_id").alias("id"),
        F.get_json_object("object", "$.title").alias("title"),
        F.length(F.get_json_object("object", "$.summary")).cast("long").alias("summary_chars"),
        F.get_json_object("object", "$.score").cast("double").alias("score"),
        "repaired",
    )


@query(
    "extracted_events",
    "WITH "
    + GOOD
    + """
SELECT doc_id AS conversation_id, CAST(0 AS INTEGER) AS nth, substr(text, 1, 200) AS title,
       strftime(day, '%Y-%m-%d') || ' 10:30:00' AS starts_at, 0.75e0 AS confidence FROM good
UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 3 = 0 THEN 'call' ELSE '(untitled)' END, NULL, 0.5e0 FROM good""",
)
def extracted_events(spark, d):
    rows = ex.ingested(responses(spark, d))["calendar_events"]
    return rows.select("conversation_id", "nth", "title", b.stamp("starts_at").alias("starts_at"), b.r6("confidence").alias("confidence"))


@query(
    "extracted_actions",
    "WITH "
    + GOOD
    + """
SELECT doc_id AS conversation_id, 'do ' || source AS text, lang AS owner, strftime(day, '%Y-%m-%d') || ' 06:00:00' AS due_at FROM good
UNION ALL SELECT doc_id, 'again', NULL, NULL FROM good WHERE doc_id % 3 > 0""",
)
def extracted_actions(spark, d):
    rows = ex.ingested(responses(spark, d))["action_items"]
    return rows.select("conversation_id", "text", "owner", b.stamp("due_at").alias("due_at"))


@query(
    "extracted_decisions",
    "WITH " + GOOD + " SELECT doc_id AS conversation_id, 'use ' || lang AS text, source AS made_by, round(least(n_chars / 1e2, 1), 6) AS confidence FROM good",
)
def extracted_decisions(spark, d):
    rows = ex.ingested(responses(spark, d))["decisions"]
    return rows.select("conversation_id", "text", "made_by", b.r6("confidence").alias("confidence"))


@query(
    "extracted_people",
    "WITH " + GOOD + " SELECT doc_id AS conversation_id, source AS name, 'seen' AS context FROM good",
)
def extracted_people(spark, d):
    return ex.ingested(responses(spark, d))["people_mentions"].select("conversation_id", "name", "context")


@query(
    "failed_answers",
    f"SELECT doc_id AS session_id, '{ex.NO_OBJECT}' AS error FROM documents WHERE doc_id % 11 = 0",
)
def failed_answers(spark, d):
    return ex.ingested(responses(spark, d))["failed"]


@query(
    "gated_categories",
    "SELECT 'action_items' AS category, 0 AS n UNION ALL SELECT 'decisions', count(*) FROM documents WHERE doc_id % 11 > 0",
)
def gated_categories(spark, d):
    found = ex.ingested(responses(spark, d), {"action_items": False})
    count = lambda name: found[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("category"), "n")
    return count("action_items").unionByName(count("decisions"))


@query(
    "cleaned_answers",
    """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN trim(html) ELSE trim(html) END AS page,
       CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS answer FROM pages""",
)
def cleaned_answers(spark, d):
    rows = given(spark, d, "pages")
    wrapped = (
        F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("```html\n"), "html", F.lit("\n```")))
        .when(F.col("page_id") % 3 == 2, F.concat(F.lit("  \n"), "html", F.lit("\n")))
        .otherwise(F.col("html"))
    )
    thought = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<think>a</think><think>b</think>"), "url")).otherwise(
        F.concat(F.lit("<think>"), "url")
    )
    return rows.select("page_id", without_fences(wrapped).alias("page"), without_thinking(thought).alias("answer"))


@query(
    "day_narratives",
    """
SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN trim(text, chr(10) || ' ') END AS narrative,
       CASE WHEN doc_id % 4 = 0 THEN '%s' END AS error FROM documents""".replace("%s", ex.NO_NARRATIVE),
)
def day_narratives(spark, d):
    told = F.to_json(F.struct(F.col("text").alias("narrative")))
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.lit('{"narrative": "  "}'))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<think>hm</think>```json\n"), told, F.lit("\n```")))
        .otherwise(told)
    )
    return ex.narratives(given(spark, d, "documents").select("doc_id", raw.alias("raw")))


@query(
    "transcription_responses",
    """
SELECT conv_id * 100 + turn AS session_id, CASE WHEN turn % 3 > 0 THEN text END AS text, 1 AS n_segments,
       CASE WHEN turn % 2 = 0 THEN 'en' ELSE role END AS language, CASE WHEN turn % 3 = 0 THEN '%s' END AS error FROM conversations""".replace("%s", ex.NO_TEXT),
)
def transcription_responses(spark, d):
    rows = given(spark, d, "conversations")
    segment = F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.col("text").alias("text"))
    raw = F.to_json(
        F.struct(
            F.when(F.col("turn") % 3 > 0, F.col("text")).otherwise(F.lit(" ")).alias("text"),
            F.array(segment).alias("segments"),
            F.when(F.col("turn") % 2 == 0, F.lit("en")).alias("language"),
            F.col("role").alias("detected_language"),
        )
    )
    found = ex.transcribed(rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("session_id"), raw.alias("raw")))
    return found.select("session_id", "text", F.size("segments").alias("n_segments"), "language", "error")


@query(
    "chat_envelopes",
    """
SELECT doc_id AS session_id, CASE WHEN doc_id % 6 > 0 THEN text END AS content, CASE WHEN doc_id % 6 > 0 THEN 'stop' END AS finish_reason,
       CASE WHEN doc_id % 6 = 0 THEN '%s' END AS error FROM documents""".replace("%s", ex.NO_TEXT),
)
def chat_envelopes(spark, d):
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))
    raw = F.when(F.col("doc_id") % 6 == 0, F.lit('{"choices": []}')).otherwise(F.to_json(F.struct(F.array(choice).alias("choices"))))
    return ex.chat_answers(given(spark, d, "documents").select(F.col("doc_id").alias("session_id"), raw.alias("raw")))


@query(
    "model_messages",
    b.with_cte("segments")
    + """
SELECT conv_id AS session_id, 0 AS nth, 'system' AS role, 'Extract.' AS content FROM conversations GROUP BY conv_id
UNION ALL
SELECT session_id, 1, 'user', 'Date: 2024-01-01 00:00 (UTC).' || chr(10) || chr(10) || 'Transcript:' || chr(10) || body || chr(10) FROM (
  SELECT session_id, string_agg('[' || lpad(CAST(CAST(floor(start_s / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':'
     || lpad(CAST(CAST(floor(start_s % 60) AS BIGINT) AS VARCHAR), 2, '0') || '] [' || speaker || '] ' || trim(text), chr(10) ORDER BY pos) AS body
  FROM segments GROUP BY session_id)""",
)
def model_messages(spark, d):
    rows = b.segments(spark, d)
    sessions = rows.select("session_id").distinct().select(
        "session_id", b.at("2024-01-01 00:00:00").alias("started_at"), F.lit("").alias("text")
    )
    return ex.messages(sessions, tr.rendered_parts(rows), "Extract.").drop("part")


@query(
    "tolerant_values",
    """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 0.5e0 ELSE round(least(1, sqrt(o_totalprice) / 6e2), 6) END AS confidence,
       CASE WHEN o_orderkey % 4 > 0 THEN round(least(1, sqrt(o_totalprice) / 6e2), 6) END AS score,
       CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS instant,
       CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day
FROM orders""",
)
def tolerant_values(spark, d):
    rows = given(spark, d, "orders")
    number = F.when(F.col("o_orderkey") % 4 == 0, F.lit("NaN")).otherwise((F.sqrt("o_totalprice") / F.lit(6e2)).cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    instant = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T99:00"))).otherwise(F.concat(day, F.lit("T00:00:00+02:00")))
    date = F.when(F.col("o_orderkey") % 5 == 0, F.concat(day, F.lit("x"))).otherwise(day)
    return rows.select(
        F.col("o_orderkey").alias("id"),
        b.r6(fv.confidence(number)).alias("confidence"),
        b.r6(fv.score_or_null(number)).alias("score"),
        b.stamp(fv.iso_timestamp(instant)).alias("instant"),
        F.date_format(fv.iso_date(date), "yyyy-MM-dd").alias("day"),
    )
