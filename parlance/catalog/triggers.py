"""Queries: trigger phrases over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.functions.text import phrase_list, shell_quoted
from parlance.operators.phrases import register_phrase_hits
from parlance.plans import changes as ch
from parlance.plans import triggers as tg
from parlance.sources.tables import given

# Phrases that also lie inside each other, and a stop phrase.
PHRASES = ("the", "tion the", "that", "he t", "la ")
STOPS = ("with", "que")

# The same phrases as three actions of one user, by number.
ACTIONS = {1: PHRASES[:2], 2: PHRASES[2:4], 3: PHRASES[4:]}

SQL_TEXTS = "texts AS (SELECT conv_id * 100 + turn AS id, text, lower(text) AS low FROM conversations)"
SQL_PHRASES = f"""
phrases AS (SELECT unnest({list(PHRASES)}) AS phrase),
parts AS (SELECT id, phrase, lower(trim(phrase)) AS key, string_split(low, lower(trim(phrase))) AS p FROM texts, phrases)"""
SQL_SWEEP = f"""
pieces AS (SELECT id, phrase, key, i, p, length(p[i]) AS len FROM (SELECT *, unnest(range(1, len(p))) AS i FROM parts)),
hits AS (SELECT id, phrase, length(key) AS klen,
   SUM(len) OVER (PARTITION BY id, phrase ORDER BY i) + (i - 1) * length(key) AS s FROM pieces),
ranked AS (SELECT id, phrase, s, s + klen AS e, ROW_NUMBER() OVER (PARTITION BY id ORDER BY s, s + klen, phrase) AS r FROM hits),
walk AS (
  SELECT id, phrase, s, e, r, true AS taken, e AS last_e FROM ranked WHERE r = 1
  UNION ALL
  SELECT n.id, n.phrase, n.s, n.e, n.r, n.s >= w.last_e, CASE WHEN n.s >= w.last_e THEN n.e ELSE w.last_e END
  FROM walk w JOIN ranked n ON n.id = w.id AND n.r = w.r + 1),
accepted AS (SELECT id, phrase, s, e, LEAD(s) OVER (PARTITION BY id ORDER BY s) AS next_s FROM walk WHERE taken),
cut AS (SELECT a.*, t.text, least(COALESCE(next_s, length(text)),
   CASE WHEN position('{STOPS[0]}' IN substr(low, CAST(e AS BIGINT) + 1)) > 0 THEN e + position('{STOPS[0]}' IN substr(low, CAST(e AS BIGINT) + 1)) - 1 ELSE length(text) END,
   CASE WHEN position('{STOPS[1]}' IN substr(low, CAST(e AS BIGINT) + 1)) > 0 THEN e + position('{STOPS[1]}' IN substr(low, CAST(e AS BIGINT) + 1)) - 1 ELSE length(text) END) AS until
  FROM accepted a JOIN texts t USING (id)),
matches AS (SELECT id, phrase, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end",
   trim(substr(text, CAST(s AS BIGINT) + 1, CAST(until - s AS BIGINT)), chr(10) || ' ') AS transcript, text FROM cut)"""
SQL_MATCHES = f"{SQL_TEXTS}, {SQL_PHRASES}, {SQL_SWEEP}"
SQL_ACTIONS = " UNION ALL ".join(f"SELECT {n} AS action, unnest({list(p)}) AS phrase" for n, p in ACTIONS.items())
SQL_ACTED = f"""
texts AS (SELECT (conv_id * 100 + turn) * 10 + n AS id, n AS action, text, lower(text) AS low FROM conversations, (SELECT unnest({list(ACTIONS)}) AS n)),
phrases AS ({SQL_ACTIONS}),
parts AS (SELECT id, phrase, lower(trim(phrase)) AS key, string_split(low, lower(trim(phrase))) AS p FROM texts JOIN phrases USING (action)), {SQL_SWEEP}"""


def texts(spark, d):
    return given(spark, d, "conversations").select(
        F.lit("me").alias("user_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("conversation_id"), "text"
    )


def action(spark):
    words = lambda items: F.array(*[F.lit(x) for x in items])
    return spark.range(1).select(
        "id",
        F.lit("me").alias("user_id"),
        words(PHRASES).alias("phrases"),
        words(STOPS).alias("stop_phrases"),
        F.lit("notify --id=$conversation_id ${wake_phrase} $unknown $$5 -- $transcript").alias("command"),
        F.lit(True).alias("enabled"),
    )


@query(
    "phrase_matches",
    "WITH RECURSIVE " + SQL_MATCHES + ' SELECT id, phrase, "start", "end", transcript FROM matches',
)
def phrase_matches(spark, d):
    rows = tg.matched(texts(spark, d), action(spark))
    return rows.select(F.col("conversation_id").alias("id"), "phrase", "start", "end", "transcript")


@query(
    "phrase_hits_in_sql",
    "WITH RECURSIVE "
    + SQL_ACTED
    + ' SELECT id // 10 AS id, CAST(id % 10 AS INTEGER) AS action, phrase, "start", "end", transcript FROM matches',
)
def phrase_hits_in_sql(spark, d):
    register_phrase_hits(spark)
    words = lambda items: F.array(*[F.lit(x) for x in items])
    lists = F.explode(F.array(*[F.struct(F.lit(n).alias("action"), words(p).alias("phrases")) for n, p in ACTIONS.items()]))
    actions = spark.range(1).select(F.lit("me").alias("user_id"), lists.alias("a")).select("user_id", "a.*", words(STOPS).alias("stops"))
    return spark.sql(
        "SELECT t.conversation_id AS id, a.action, h.phrase, h.start, h.end, h.transcript "
        "FROM {texts} t JOIN {actions} a ON a.user_id = t.user_id, LATERAL phrase_hits(t.text, a.phrases, a.stops) h",
        texts=texts(spark, d),
        actions=actions,
    )


@query(
    "trigger_invocations",
    "WITH RECURSIVE "
    + SQL_MATCHES
    + """,
quoted AS (SELECT *, CASE WHEN regexp_full_match(transcript, '[a-zA-Z0-9_@%+=:,./-]+') THEN transcript
    ELSE '''' || replace(transcript, '''', '''"''"''') || '''' END AS qt,
  CASE WHEN regexp_full_match(phrase, '[a-zA-Z0-9_@%+=:,./-]+') THEN phrase ELSE '''' || phrase || '''' END AS qp FROM matches)
SELECT id, "start", phrase AS matched_phrase, 'notify --id=' || id || ' ' || qp || ' $unknown $5 -- ' || qt AS command_resolved FROM quoted""",
)
def trigger_invocations(spark, d):
    return tg.invocations(texts(spark, d), action(spark)).select(
        F.col("conversation_id").alias("id"), "start", "matched_phrase", "command_resolved"
    )


@query(
    "phrase_lists",
    """
SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '[\\r\\n,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS phrases
FROM documents""",
)
def phrase_lists(spark, d):
    return given(spark, d, "documents").select("doc_id", F.array_join(phrase_list(F.col("text")), "|").alias("phrases"))


@query(
    "shell_words",
    """
SELECT page_id, CASE WHEN regexp_full_match(url, '[a-zA-Z0-9_@%+=:,./-]+') THEN url ELSE '''' || replace(url, '''', '''"''"''') || '''' END AS word,
  '''' || replace(html, '''', '''"''"''') || '''' AS page FROM pages""",
)
def shell_words(spark, d):
    return given(spark, d, "pages").select("page_id", shell_quoted(F.col("url")).alias("word"), shell_quoted(F.col("html")).alias("page"))


@query(
    "checked_trigger_actions",
    """
SELECT p_partkey AS id, trim(p_name) AS name, p_brand || '|' || p_type AS phrases, greatest(1e0, least(300e0, p_size * 10e0)) AS timeout_seconds
FROM part WHERE p_size % 3 > 0 AND trim(p_name) <> ''""",
)
def checked_trigger_actions(spark, d):
    form = given(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"),
        F.when(F.col("p_size") % 3 > 0, F.concat("p_brand", F.lit(" ,\n, "), "p_type")).otherwise(F.lit(" , ")).alias("phrases"),
        F.lit("").alias("stop_phrases"),
        F.lit("say $transcript").alias("command"),
        (F.col("p_size") * F.lit(10.0)).alias("timeout_seconds"),
    )
    return ch.checked_actions(form).select("id", "name", F.array_join("phrases", "|").alias("phrases"), "timeout_seconds")
