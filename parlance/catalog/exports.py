"""Queries: calendar feeds, silence logs, evaluation files, catalogue of captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.plans import archive as ar
from parlance.plans import evals as ev
from parlance.session import shared_path
from parlance.sources import calendar as ics
from parlance.sources import capture, evalfiles
from parlance.sources import tables as tb
from parlance.sources.tables import given

STAMP = "2024-02-01 00:00:00"


def dated(spark, d):
    return ar.with_conversation(b.cal(spark, d), b.conv(spark, d))


ESC = r"replace(replace(replace(replace(%s, '\', '\\'), ';', '\;'), ',', '\,'), chr(10), '\n')"
SQL_BLOCKS = (
    """
items AS (SELECT e.*, c.title AS conversation_title FROM cal e JOIN conv c ON c.id = e.conversation_id WHERE e.starts_at IS NOT NULL),
texts AS (SELECT *, concat_ws(chr(10), description, 'confidence: ' || CAST(round_even(confidence * 100, 0) AS BIGINT) || '%%',
    'from: ' || NULLIF(conversation_title, ''), 'conversation: ' || conversation_id) AS d FROM items),
unfolded AS (SELECT id, starts_at, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || id || '@parlance', 'DTSTAMP:20240201T000000Z',
    'DTSTART:' || strftime(starts_at, '%%Y%%m%%dT%%H%%M%%SZ'), 'DTEND:' || strftime(COALESCE(ends_at, starts_at + INTERVAL 1 HOUR), '%%Y%%m%%dT%%H%%M%%SZ'),
    'SUMMARY:' || %s, 'LOCATION:' || %s, 'DESCRIPTION:' || %s, 'END:VEVENT') AS block FROM texts)"""
    % (ESC % "title", ESC % "location", ESC % "d")
)


@query(
    "calendar_blocks",
    b.with_cte("activity", "conv", "cal") + "," + SQL_BLOCKS + " SELECT id, block FROM unfolded",
)
def calendar_blocks(spark, d):
    """Blocks with the line folding undone; every line is checked to be short enough."""
    rows = ics.event_blocks(dated(spark, d), STAMP)
    lines = F.split("block", "\r\n")
    fits = F.forall(lines, lambda x: F.octet_length(x) <= 75)
    return rows.select("id", F.when(fits, F.replace("block", F.lit("\r\n "), F.lit(""))).alias("block"))


@query(
    "calendar_feed",
    b.with_cte("activity", "conv", "cal")
    + ","
    + SQL_BLOCKS
    + """
SELECT 0 AS part, '' AS id, 'BEGIN:VCALENDAR' AS first_line UNION ALL SELECT 2, '', 'END:VCALENDAR'
UNION ALL SELECT 1, CAST(u.id AS VARCHAR), 'BEGIN:VEVENT' FROM unfolded u JOIN items i USING (id) WHERE i.confidence >= 0.3""",
)
def calendar_feed(spark, d):
    rows = ics.feed(dated(spark, d), STAMP, min_confidence=0.3)
    return rows.select("part", "id", F.substring_index("block", "\r\n", 1).alias("first_line"))


@query(
    "calendar_files",
    b.with_cte("activity", "conv", "cal")
    + """
SELECT e.id, replace(title, ' ', '_') || '-' || e.id || '.ics' AS file_name FROM (SELECT e.id, e.starts_at, e.title FROM cal e JOIN conv c ON c.id = e.conversation_id) e
WHERE starts_at IS NOT NULL""",
)
def calendar_files(spark, d):
    return ics.single_event(dated(spark, d), STAMP).select("id", "file_name")


SQL_LOG = """
marks AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type AS kind FROM events WHERE event_type IN ('view', 'click')),
prev AS (SELECT *, LAG(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS pk, LAG(us) OVER (PARTITION BY user_id ORDER BY event_id) AS pu FROM marks)"""


@query(
    "logged_silences",
    "WITH " + SQL_LOG + " SELECT user_id, round((pu - 1704067200000000) / 1e6, 6) AS start_s, round((us - 1704067200000000) / 1e6, 6) AS end_s FROM prev WHERE kind = 'click' AND pk = 'view'",
)
def logged_silences(spark, d):
    """Log lines made from events: a view starts a silence, a click ends one."""
    rows = b.activity(spark, d)
    at = F.format_string("%.6f", F.col("t"))
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("[x] silence_start: "), at))
        .when(F.col("event_type") == "click", F.concat(F.lit("[x] silence_end: "), at, F.lit(" | silence_duration: 1")))
        .otherwise(F.lit("frame= 1"))
    )
    lines = rows.select("user_id", F.col("event_id").alias("line_no"), line.alias("line"))
    found = capture.paired_silences(lines, ("user_id",))
    return found.select("user_id", b.r6("start").alias("start_s"), b.r6("end").alias("end_s"))


@query(
    "logged_durations",
    "SELECT user_id, arg_min(value, event_id) AS duration_s FROM events GROUP BY user_id",
)
def logged_durations(spark, d):
    v = F.col("value")
    line = F.format_string(
        "  Duration: %02d:%02d:%05.2f, start: 0", F.lit(0), F.floor(v / 60).cast("int"), v - F.floor(v / 60) * 60
    )
    lines = b.activity(spark, d).select("user_id", F.col("event_id").alias("line_no"), line.alias("line"))
    found = capture.logged_durations(lines, ("user_id",))
    return found.select("user_id", F.round("duration_s", 2).alias("duration_s"))


@query(
    "accepted_files",
    """
SELECT page_id, CASE WHEN length(html) % 7 = 0 THEN 'rejected' ELSE 'pending_vad' END AS status,
       CASE page_id % 3 WHEN 0 THEN 'wav' WHEN 1 THEN 'ogg' ELSE 'bin' END AS codec FROM pages""",
)
def accepted_files(spark, d):
    """Pages as landed files: path and length; some are empty."""
    suffix = F.when(F.col("page_id") % 3 == 0, ".WAV").when(F.col("page_id") % 3 == 1, ".ogg").otherwise("")
    files = given(spark, d, "pages").select(
        F.concat(F.lit("/landing/x.y/"), F.col("page_id").cast("string"), suffix).alias("path"),
        F.when(F.length("html") % 7 == 0, F.lit(0)).otherwise(F.length("html")).cast("long").alias("length"),
        F.current_timestamp().alias("modificationTime"),
    )
    good, bad = capture.accepted(files)
    number = lambda c: F.regexp_extract(c, r"/(\d+)[^/]*$", 1).cast("long").alias("page_id")
    from parlance.functions.values import codec_of

    return good.select(number("audio_path"), "status", "codec").unionByName(
        bad.select(number("path"), F.lit("rejected").alias("status"), codec_of(F.col("path")).alias("codec"))
    )


@query(
    "latest_case_metrics",
    """
SELECT 'doc' || doc_id AS "case", CASE WHEN doc_id % 2 = 0 THEN '2024-02-02' ELSE '2024-02-01' END AS ts,
       round(CASE WHEN doc_id % 2 = 0 THEN n_chars / 2e3 ELSE n_chars / 1e3 END, 6) AS wer FROM documents""",
)
def latest_case_metrics(spark, d):
    """Two runs appended to a history with unreadable lines; the newest metrics per case."""
    rows = given(spark, d, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("case"), "doc_id", (F.col("n_chars") / F.lit(1000.0)).alias("wer")
    )
    folder = shared_path(spark, "history")
    evalfiles.append_history(rows.drop("doc_id"), folder, "2024-02-01")
    evalfiles.append_history(
        rows.filter("doc_id % 2 = 0").select("case", (F.col("wer") / 2).alias("wer")), folder, "2024-02-02", "half"
    )
    given(spark, d, "benchmark").select(F.concat(F.lit("{"), F.regexp_replace("text", "\n", " ")).alias("value")).write.mode("append").text(folder)
    return evalfiles.latest_metrics(spark, folder).select("case", "ts", b.r6("wer").alias("wer"))


@query(
    "recorded_runs",
    """
SELECT n AS nth, '2024-02-0' || CASE WHEN n < 2 THEN 1 ELSE 2 END AS ts, (SELECT count(*) FROM documents WHERE doc_id % 3 >= n) AS cases,
       round((SELECT sum(n_chars) FROM documents WHERE doc_id % 3 >= n) / (SELECT sum(n_chars + 10) FROM documents WHERE doc_id % 3 >= n), 6) AS wer,
       CASE WHEN n = 1 THEN 'fr' ELSE 'en' END AS language, n <> 1 AS as_first FROM (SELECT unnest([0, 1, 2]) AS n)""",
)
def recorded_runs(spark, d):
    """Three runs over fewer and fewer documents, two of them at the same time, with their settings and totals."""
    rows = given(spark, d, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("case"), "doc_id",
        F.col("n_chars").cast("long").alias("substitutions"), F.lit(0).cast("long").alias("insertions"), F.lit(0).cast("long").alias("deletions"),
        (F.col("n_chars") + 10).cast("long").alias("ref_words"), *[F.lit(0.0).alias(c) for c in ("miss_s", "false_alarm_s", "confusion_s", "ref_speech_s", "user_acc", "ref_user_s")],
        F.lit(None).cast("string").alias("error"),
    )
    folder = shared_path(spark, "runs")
    for n in range(3):
        of_run = rows.filter(F.col("doc_id") % 3 >= n).drop("doc_id")
        settings = {"language": "fr" if n == 1 else "en", "beam": "5"}
        evalfiles.append_history(of_run, folder, f"2024-02-0{1 if n < 2 else 2}", settings=settings, totals=ev.suite_totals(of_run))
    runs = evalfiles.recorded_runs(spark, folder)
    first = runs.filter("run = 0").select(F.col("fingerprint").alias("first_print"))
    seen = runs.join(first, F.col("fingerprint") == F.col("first_print"), "left")
    return seen.select(
        F.col("run").cast("int").alias("nth"), "ts", "totals.cases", b.r6("totals.wer").alias("wer"), F.col("settings")["language"].alias("language"),
        F.col("first_print").isNotNull().alias("as_first"),
    )


@query(
    "updated_case_meta",
    """
SELECT doc_id, '{"lang":"' || lang || '","name":"' || source || '","verified":"' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '"}' AS meta
FROM documents""",
)
def updated_case_meta(spark, d):
    text = lambda *pairs: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in pairs])
    old = text("verified", F.lit("false"), "name", F.col("source"))
    new = F.when(F.col("doc_id") % 2 == 0, text("verified", F.lit("true"), "lang", F.col("lang"))).otherwise(text("lang", F.col("lang")))
    merged = evalfiles.with_meta(old, new)
    ordered = F.map_from_entries(F.array_sort(F.map_entries(merged)))
    return given(spark, d, "documents").select("doc_id", F.to_json(ordered).alias("meta"))


@query(
    "segment_codec",
    b.with_cte("segments")
    + """
SELECT session_id, pos, speaker, text FROM segments
UNION ALL SELECT 1000000 + doc_id, -1, NULL, NULL FROM labels WHERE false""",
)
def segment_codec(spark, d):
    """Turns written as a JSON column per turn and read back; broken JSON yields no segment."""
    rows = b.segments(spark, d).select(
        "session_id",
        "pos",
        tb.encode_segments(
            F.array(F.struct("start", "end", "text", "speaker", F.lit(None).cast("string").alias("speaker_id")))
        ).alias("raw"),
    )
    broken = rows.withColumn("raw", F.substring("raw", 1, 9))
    back = lambda df: df.select("session_id", "pos", F.explode(tb.decode_segments(F.col("raw"))).alias("s"))
    both = back(rows).unionByName(back(broken)).filter(F.col("s.text").isNotNull())
    return both.select("session_id", "pos", "s.speaker", "s.text")


@query(
    "evolved_rows",
    """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN least(n_chars / 1e5, 1) ELSE 0.5e0 END AS quality_score,
       false AS extraction_repaired, source AS user_id FROM documents""",
)
def evolved_rows(spark, d):
    """Rows of an older layout brought to the current columns and defaults."""
    old = given(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("user_id"),
        F.when(F.col("doc_id") % 2 == 0, F.least(F.col("n_chars") / F.lit(1e5), F.lit(1.0))).alias("quality_score"),
    )
    return tb.evolve(old, "conversations").select("id", b.r6("quality_score").alias("quality_score"), "extraction_repaired", "user_id")


@query(
    "child_capture_sessions",
    b.with_cte("activity")
    + """,
flags AS (SELECT *, CASE WHEN t - LAG(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 43200 THEN 0 ELSE 1 END AS o FROM activity),
ids AS (SELECT *, SUM(o) OVER (PARTITION BY user_id ORDER BY t, event_id) AS idx FROM flags),
cuts AS (SELECT user_id, idx, min(t) AS s, max(t) AS e FROM ids GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) || '-' || CAST(idx AS BIGINT) AS id, strftime(TIMESTAMP '2024-01-01' + to_microseconds(CAST(round(s * 1e6) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS started_at,
       round(e - s, 6) AS duration_s, 'pending_stt' AS status FROM cuts
UNION ALL SELECT CAST(user_id AS VARCHAR), '2024-01-01 00:00:00', 0, 'segmented' FROM activity GROUP BY user_id""",
)
def child_capture_sessions(spark, d):
    from parlance.plans import segmentation as seg

    cuts = seg.activity_conversations(b.activity(spark, d), 43200.0).select(
        F.col("user_id").cast("string").alias("session_id"), "idx", F.col("start_s").alias("start"), F.col("end_s").alias("end")
    )
    parents = b.activity(spark, d).select(F.col("user_id").cast("string").alias("id")).distinct().select(
        "id", F.lit("me").alias("user_id"), b.at("2024-01-01 00:00:00").alias("started_at"), F.lit("pending_vad").alias("status")
    )
    children, updated = seg.child_sessions(parents, cuts)
    return children.select("id", b.stamp("started_at").alias("started_at"), b.r6("duration_s").alias("duration_s"), "status").unionByName(
        updated.select("id", b.stamp("started_at").alias("started_at"), F.lit(0.0).alias("duration_s"), "status")
    )


@query("config_fingerprints", "SELECT lang, count(*) AS n, 16 AS n_digits FROM documents GROUP BY lang")
def config_fingerprints(spark, d):
    settings = F.create_map(F.lit("b"), F.col("lang"), F.lit("a"), F.lit("1"))
    swapped = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("lang"))
    same = ev.fingerprint(settings) == ev.fingerprint(swapped)
    rows = given(spark, d, "documents").filter(same).groupBy("lang", ev.fingerprint(settings).alias("print")).agg(F.count("*").alias("n"))
    return rows.select("lang", "n", F.length("print").alias("n_digits"))
