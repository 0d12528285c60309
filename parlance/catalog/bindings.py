"""How the given tables play the archive's tables, in Spark and as SQL CTEs.

Every binding reads its whole table.  The CTE of the same name computes the same
columns for the SQL twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.scans import Scan, prefix_scan
from parlance.operators.vectors import mean_vectors
from parlance.session import spread
from parlance.sources.tables import given

EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z
AS_OF = "2024-01-20 00:00:00"
CHARS_PER_SECOND = 15.0
LENGTH_FACTOR = 600.0
TURN_CHUNK = 1024

CTE: dict[str, str] = {}


def with_cte(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause of the named CTEs."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTE[n] for n in names)


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


# -- events -----------------------------------------------------------------------------

CTE["activity"] = f"""activity AS (
  SELECT event_id, user_id, event_type, value, ts,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         (epoch_us(ts) - {EPOCH_US}) / 1e6 AS t
  FROM events)"""


def activity(spark: SparkSession, d: str) -> DataFrame:
    """Events as capture activity: ``t`` seconds since the epoch of the data."""
    return given(spark, d, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "ts",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        ((F.unix_micros("ts") - EPOCH_US) / F.lit(1e6)).alias("t"),
    )


CTE["spoken"] = f"""spoken AS (
  SELECT user_id AS session_id, event_id AS pos, event_type AS speaker, k,
         t AS start_s, t + value * {LENGTH_FACTOR}e0 AS end_s
  FROM activity)"""


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Events as labelled intervals of one long session per user."""
    return activity(spark, d).select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("speaker"),
        "k",
        F.col("t").alias("start"),
        (F.col("t") + F.col("value") * F.lit(LENGTH_FACTOR)).alias("end"),
    )


# -- conversations ----------------------------------------------------------------------

CTE["segments"] = f"""segments AS (
  SELECT conv_id AS session_id, turn AS pos, role AS speaker, text,
         COALESCE(SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {CHARS_PER_SECOND}e0 AS start_s,
         SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) / {CHARS_PER_SECOND}e0 AS end_s
  FROM conversations)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as transcript segments, timed by their characters."""
    rows = given(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text"
    )
    timed = prefix_scan(
        rows,
        ["session_id"],
        F.floor(F.col("pos") / TURN_CHUNK),
        ["pos"],
        {"chars": Scan("sum", F.length("text"))},
    )
    return timed.select(
        "session_id",
        "pos",
        "speaker",
        "text",
        ((F.col("chars") - F.length("text")) / F.lit(CHARS_PER_SECOND)).alias("start"),
        (F.col("chars") / F.lit(CHARS_PER_SECOND)).alias("end"),
    )


# -- documents --------------------------------------------------------------------------

CTE["lines"] = """lines AS (
  SELECT doc_id AS session_id, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS text,
         'S' || ((i - 1) % 2) AS speaker, (i - 1) * 2e0 AS start_s, (i - 1) * 2e0 + 15e-1 AS end_s
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i))"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Document lines as transcript segments two seconds apart."""
    return (
        spread(given(spark, d, "documents").select("doc_id", "text"))
        .select(F.col("doc_id").alias("session_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
        .select(
            "session_id",
            F.col("pos").cast("long").alias("pos"),
            "text",
            F.concat(F.lit("S"), (F.col("pos") % 2).cast("string")).alias("speaker"),
            (F.col("pos") * F.lit(2.0)).alias("start"),
            (F.col("pos") * F.lit(2.0) + F.lit(1.5)).alias("end"),
        )
    )


CTE["frames"] = """frames AS (
  SELECT doc_id AS session_id, CAST(i - 1 AS BIGINT) AS frame_idx,
         least(length(parts[i]) / 1e1, 1e0) AS prob
  FROM (SELECT doc_id, string_split(text, ' ') AS parts FROM documents),
       LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i))"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Document words as voice-activity frames: longer words are more likely speech."""
    return (
        spread(given(spark, d, "documents").select("doc_id", "text"))
        .select(F.col("doc_id").alias("session_id"), F.posexplode(F.split("text", " ", -1)).alias("frame_idx", "word"))
        .select(
            "session_id",
            F.col("frame_idx").cast("long").alias("frame_idx"),
            F.least(F.length("word") / F.lit(10.0), F.lit(1.0)).alias("prob"),
        )
    )


# -- embeddings -------------------------------------------------------------------------

USERS = 5

CTE["clusters"] = f"""clusters AS (
  SELECT vec_id AS cluster_id, vec_id % {USERS} AS user_id, vec_id // 10 AS session_id, label AS voice,
         'SPEAKER_' || lpad(CAST(vec_id % 10 AS VARCHAR), 2, '0') AS label,
         CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)"""


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustered(given(spark, d, "embeddings"))


def clustered(embeddings: DataFrame) -> DataFrame:
    """Embeddings as speaker clusters: ten per session, users share the sessions out."""
    return embeddings.select(
        F.col("vec_id").alias("cluster_id"),
        (F.col("vec_id") % USERS).alias("user_id"),
        F.floor(F.col("vec_id") / 10).cast("long").alias("session_id"),
        F.col("label").alias("voice"),
        F.concat(F.lit("SPEAKER_"), F.lpad((F.col("vec_id") % 10).cast("string"), 2, "0")).alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


CTE["voices"] = """voices AS (
  SELECT user_id, user_id * 100 + voice AS id, list(m ORDER BY i) AS embedding, max(n) AS mention_count,
         CASE WHEN voice % 3 > 0 THEN 'Voice ' || voice END AS name, voice % 4 = 0 AS is_user,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(voice AS INTEGER)) AS created_at
  FROM (SELECT user_id, voice, i, avg(embedding[i]) AS m, count(*) AS n
        FROM clusters, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i) GROUP BY ALL)
  GROUP BY user_id, voice)"""


def voices(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector per user and label as known speakers."""
    rows = clusters(spark, d)
    means = mean_vectors(rows, ["user_id", "voice"], "embedding")
    counts = rows.groupBy("user_id", "voice").agg(F.count("*").cast("int").alias("mention_count"))
    return means.join(counts, ["user_id", "voice"]).select(
        "user_id",
        (F.col("user_id") * 100 + F.col("voice")).alias("id"),
        "embedding",
        "mention_count",
        F.when(F.col("voice") % 3 > 0, F.concat(F.lit("Voice "), F.col("voice").cast("string"))).alias("name"),
        (F.col("voice") % 4 == 0).alias("is_user"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("voice"))).alias("created_at"),
    )


# -- the archive ------------------------------------------------------------------------


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def stamp(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def minutes_after(start: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + minutes.cast("long") * 60_000_000)


CTE["conv"] = """conv AS (
  SELECT d.doc_id AS id, d.doc_id AS audio_session_id, source AS user_id,
         CASE WHEN d.doc_id % 5 > 0 THEN split_part(text, chr(10), 1) END AS title,
         CASE WHEN d.doc_id % 7 > 0 THEN lang || ' ' || n_chars END AS summary,
         least(n_chars / 5e3, 1e0) AS quality_score, CAST(l.quality AS DOUBLE) AS quality_override,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id * 37 AS BIGINT)) AS started_at,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id * 37 + 5 AS BIGINT)) AS created_at
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def conv(spark: SparkSession, d: str) -> DataFrame:
    """Documents as archived conversations, their labels as quality overrides."""
    docs = given(spark, d, "documents").join(given(spark, d, "labels"), "doc_id", "left")
    epoch = at("2024-01-01 00:00:00")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("audio_session_id"),
        F.col("source").alias("user_id"),
        F.when(F.col("doc_id") % 5 > 0, F.substring_index("text", "\n", 1)).alias("title"),
        F.when(F.col("doc_id") % 7 > 0, F.concat_ws(" ", "lang", F.col("n_chars").cast("string"))).alias("summary"),
        F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("quality_score"),
        F.col("quality").cast("double").alias("quality_override"),
        minutes_after(epoch, F.col("doc_id") * 37).alias("started_at"),
        minutes_after(epoch, F.col("doc_id") * 37 + 5).alias("created_at"),
    )


CTE["cal"] = """cal AS (
  SELECT event_id AS id, event_id // 10 AS conversation_id, event_type || ' ' || k AS title,
         CASE WHEN k % 4 > 0 THEN 'see, note ' || k || '; ' || event_type END AS description,
         CASE WHEN k % 10 > 0 THEN ts + to_hours(k) END AS starts_at,
         CASE WHEN k % 10 > 0 AND k % 3 = 0 THEN ts + to_hours(k) + to_minutes(30) END AS ends_at,
         CASE WHEN k % 2 = 0 THEN 'room, ' || k END AS location,
         least(value / 1e2, 1e0) AS confidence, k % 6 = 0 AS exported_to_ics
  FROM activity WHERE event_type = 'purchase')"""


def cal(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as calendar events."""
    rows = activity(spark, d).filter("event_type = 'purchase'")
    starts = F.when(F.col("k") % 10 > 0, minutes_after(F.col("ts"), F.col("k") * 60))
    return rows.select(
        F.col("event_id").alias("id"),
        F.floor(F.col("event_id") / 10).cast("long").alias("conversation_id"),
        F.concat_ws(" ", "event_type", F.col("k").cast("string")).alias("title"),
        F.when(
            F.col("k") % 4 > 0, F.concat(F.lit("see, note "), F.col("k").cast("string"), F.lit("; "), "event_type")
        ).alias("description"),
        starts.alias("starts_at"),
        F.when(F.col("k") % 3 == 0, minutes_after(starts, F.lit(30))).alias("ends_at"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("room, "), F.col("k").cast("string"))).alias("location"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("confidence"),
        (F.col("k") % 6 == 0).alias("exported_to_ics"),
    )


CTE["tasks"] = """tasks AS (
  SELECT o_orderkey AS id, o_orderkey // 15 AS conversation_id, o_orderpriority || ' ' || o_custkey AS text,
         CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderdate END AS due_at,
         CASE WHEN o_custkey % 3 > 0 THEN 'c' || o_custkey END AS owner,
         CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'dismissed' END AS status
  FROM orders)"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as action items."""
    return given(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.floor(F.col("o_orderkey") / 15).cast("long").alias("conversation_id"),
        F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string")).alias("text"),
        F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderdate")).alias("due_at"),
        F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("owner"),
        F.when(F.col("o_orderstatus") == "O", "open")
        .when(F.col("o_orderstatus") == "F", "done")
        .otherwise("dismissed")
        .alias("status"),
    )


CTE["mentions"] = """mentions AS (
  SELECT event_id AS id, event_id // 10 AS conversation_id,
         CASE WHEN event_id % 2 = 0 THEN ' Person ' || (k % 40) ELSE 'PERSON ' || (k % 40) END AS name,
         event_type || ' ' || k AS context, ts AS mentioned_at
  FROM activity WHERE event_type IN ('view', 'click'))"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Views and clicks as mentions of people, spelled in two ways."""
    rows = activity(spark, d).filter(F.col("event_type").isin("view", "click"))
    number = (F.col("k") % 40).cast("string")
    return rows.select(
        F.col("event_id").alias("id"),
        F.floor(F.col("event_id") / 10).cast("long").alias("conversation_id"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" Person "), number))
        .otherwise(F.concat(F.lit("PERSON "), number))
        .alias("name"),
        F.concat_ws(" ", "event_type", F.col("k").cast("string")).alias("context"),
        F.col("ts").alias("mentioned_at"),
    )


CTE["decided"] = """decided AS (
  SELECT event_id AS id, event_id // 10 AS conversation_id, 'decision ' || k AS text, ts AS created_at
  FROM activity WHERE event_type = 'error')"""


def decided(spark: SparkSession, d: str) -> DataFrame:
    """Errors as decisions."""
    return activity(spark, d).filter("event_type = 'error'").select(
        F.col("event_id").alias("id"),
        F.floor(F.col("event_id") / 10).cast("long").alias("conversation_id"),
        F.concat(F.lit("decision "), F.col("k").cast("string")).alias("text"),
        F.col("ts").alias("created_at"),
    )


CTE["fired"] = """fired AS (
  SELECT event_id AS id, event_id // 10 AS conversation_id, k % 30 AS wake_action_id, 'phrase ' || (k % 5) AS matched_phrase,
         ts AS created_at
  FROM activity WHERE event_type = 'signup')"""


def fired(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups as trigger invocations; some point at deleted actions."""
    return activity(spark, d).filter("event_type = 'signup'").select(
        F.col("event_id").alias("id"),
        F.floor(F.col("event_id") / 10).cast("long").alias("conversation_id"),
        (F.col("k") % 30).alias("wake_action_id"),
        F.concat(F.lit("phrase "), (F.col("k") % 5).cast("string")).alias("matched_phrase"),
        F.col("ts").alias("created_at"),
    )


CTE["actions"] = """actions AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, 'src' || (n_nationkey % 20) AS user_id, n_name AS name,
         n_nationkey % 6 > 0 AS enabled,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(n_nationkey AS INTEGER)) AS created_at
  FROM nation)"""


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Nations as trigger actions."""
    return given(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.concat(F.lit("src"), (F.col("n_nationkey") % 20).cast("string")).alias("user_id"),
        F.col("n_name").alias("name"),
        (F.col("n_nationkey") % 6 > 0).alias("enabled"),
        (at("2024-01-01 00:00:00") + F.make_dt_interval(F.col("n_nationkey"))).alias("created_at"),
    )


STATUS_CASES = ("recording", "pending_vad", "segmented", "pending_stt", "pending_llm", "done", "silent", "failed")

CTE["sessions"] = f"""sessions AS (
  SELECT o_orderkey AS id, 'u' || (o_custkey % 50) AS user_id,
         CASE WHEN o_orderkey % 4 > 0 AND o_orderkey > 3 THEN o_orderkey // 4 END AS parent_id,
         o_orderdate AS started_at, o_totalprice / 1e2 AS duration_s, CAST(floor(o_totalprice * 10) AS BIGINT) AS bytes_written,
         CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN '/elsewhere/' ELSE '/audio/' END
              || (o_custkey % 50) || '/' || o_orderkey || '.ogg' END AS audio_path,
         {list(STATUS_CASES)}[1 + o_orderkey % 8] AS status,
         CASE WHEN o_orderkey % 8 = 7 THEN 'stage ' || o_orderpriority END AS error_msg,
         o_orderkey % 7 = 0 AS archived
  FROM orders)"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as capture sessions: a forest of parents and children in all states."""
    key = F.col("o_orderkey")
    owner = (F.col("o_custkey") % 50).cast("string")
    folder = F.when(key % 11 == 0, "/elsewhere/").otherwise("/audio/")
    return given(spark, d, "orders").select(
        key.alias("id"),
        F.concat(F.lit("u"), owner).alias("user_id"),
        F.when((key % 4 > 0) & (key > 3), F.floor(key / 4).cast("long")).alias("parent_id"),
        F.col("o_orderdate").alias("started_at"),
        (F.col("o_totalprice") / F.lit(100.0)).alias("duration_s"),
        F.floor(F.col("o_totalprice") * 10).cast("long").alias("bytes_written"),
        F.when(key % 3 > 0, F.concat(folder, owner, F.lit("/"), key.cast("string"), F.lit(".ogg"))).alias("audio_path"),
        F.element_at(F.array(*[F.lit(s) for s in STATUS_CASES]), (key % 8 + 1).cast("int")).alias("status"),
        F.when(key % 8 == 7, F.concat(F.lit("stage "), "o_orderpriority")).alias("error_msg"),
        (key % 7 == 0).alias("archived"),
    )


CTE["versions"] = """versions AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS id, l_orderkey AS audio_session_id, l_shipdate AS created_at,
         l_returnflag || l_linestatus || ' ' || l_partkey AS text, CASE WHEN l_linenumber % 2 = 0 THEN 'en' ELSE 'auto' END AS language
  FROM lineitem)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as successive transcripts of a session."""
    return given(spark, d, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("id"),
        F.col("l_orderkey").alias("audio_session_id"),
        F.col("l_shipdate").alias("created_at"),
        F.concat("l_returnflag", "l_linestatus", F.lit(" "), F.col("l_partkey").cast("string")).alias("text"),
        F.when(F.col("l_linenumber") % 2 == 0, "en").otherwise("auto").alias("language"),
    )
