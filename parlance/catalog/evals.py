"""Queries: word errors, diarization errors, attribution, suites."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.operators import intervals as iv
from parlance.plans import evals as ev
from parlance.session import shared_path
from parlance.sources import casefolders, evalfiles
from parlance.sources.tables import given

DAY = 24 * 3600.0
COLLAR = 300.0
BUCKET_S = 6 * 3600.0


def pairs(spark, d):
    """Each conversation turn (reference) against the next one (hypothesis), whole texts."""
    rows = given(spark, d, "conversations")
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return rows.join(following, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("case"), F.col("text").alias("reference"), "hypothesis"
    )


SQL_PAIRS = """
words AS (SELECT conv_id * 100 + turn AS id, conv_id, turn,
   list_filter(string_split(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '\\(×\\d+\\)', ' ', 'g'),
       '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM conversations),
pairs AS (SELECT r.id AS case_id, r.w AS r, h.w AS h FROM words r JOIN words h ON h.conv_id = r.conv_id AND h.turn = r.turn + 1),
walk AS (
  SELECT case_id, 0 AS i, r, h, list_transform(range(len(h) + 1), lambda j: j * (C + N)) AS row_ FROM pairs
  UNION ALL
  SELECT case_id, i + 1, r, h, list_reduce(
    list_prepend([(i + 1) * (C + D)],
      list_transform(h, lambda x, j: [row_[j], row_[j + 1], CASE WHEN x = r[i + 1] THEN 1 ELSE 0 END])),
    lambda acc, e: list_append(acc, CASE
      WHEN e[3] = 1 THEN e[1]
      WHEN e[1] >> 45 <= e[2] >> 45 AND e[1] >> 45 <= acc[-1] >> 45 THEN e[1] + C + S
      WHEN e[2] >> 45 <= acc[-1] >> 45 THEN e[2] + C + D
      ELSE acc[-1] + C + N END))
  FROM walk WHERE i < len(r)),
last AS (SELECT case_id, len(r) AS ref_words, len(h) AS hyp_words, (row_[-1] >> 30) & 32767 AS substitutions,
                (row_[-1] >> 15) & 32767 AS insertions, row_[-1] & 32767 AS deletions FROM walk WHERE i = len(r)),
scores AS (SELECT *, ref_words - substitutions - deletions AS hits FROM last)"""
# A cell packs cost, substitutions, insertions and deletions, 15 bits each.
for _name, _value in (("C", 1 << 45), ("S", 1 << 30), ("N", 1 << 15), ("D", 1)):
    SQL_PAIRS = re.sub(rf"\b{_name}\b(?!\}})", str(_value), SQL_PAIRS)

WORD_COLUMNS = ("substitutions", "insertions", "deletions", "hits", "ref_words", "hyp_words")


@query(
    "word_errors",
    "WITH RECURSIVE "
    + SQL_PAIRS
    + """
SELECT case_id AS "case", round((substitutions + insertions + deletions) / ref_words, 6) AS wer,
       substitutions, insertions, deletions, hits, ref_words, hyp_words FROM scores""",
)
def word_errors(spark, d):
    return ev.word_errors(pairs(spark, d)).select("case", b.r6("wer").alias("wer"), *WORD_COLUMNS)


def reference(spark, d):
    return b.spoken(spark, d).withColumnRenamed("session_id", "case")


def hypothesis(spark, d):
    """Another labelling: shifted by ten minutes, kinds renamed, every tenth interval confused."""
    named = (
        F.when(F.col("k") % 10 == 0, F.lit("P"))
        .when(F.col("speaker") == "view", F.lit("USER"))
        .otherwise(F.upper(F.substring("speaker", 1, 2)))
    )
    return reference(spark, d).withColumns(
        {"speaker": named, "start": F.col("start") + 600, "end": F.col("end") + 600}
    )


def sql_der(ref: str, hyp: str, collar: float) -> str:
    """CTEs that score one labelling against another."""
    return f"""
sides AS (SELECT 'r' AS side, session_id, speaker, start_s, end_s FROM {ref} UNION ALL SELECT 'h', session_id, speaker, start_s, end_s FROM {hyp}),
f1 AS (SELECT *, CASE WHEN start_s <= MAX(end_s) OVER (PARTITION BY side, session_id, speaker ORDER BY start_s, end_s
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM sides),
f2 AS (SELECT *, SUM(o) OVER (PARTITION BY side, session_id, speaker ORDER BY start_s, end_s) AS g FROM f1),
ivs AS (SELECT side, session_id, speaker, MIN(start_s) AS s, MAX(end_s) AS e FROM f2 GROUP BY side, session_id, speaker, g),
edges AS (SELECT DISTINCT session_id, unnest([s, e]) AS p FROM ivs WHERE side = 'r'),
c1 AS (SELECT session_id, p - {collar} AS s, p + {collar} AS e FROM edges),
c2 AS (SELECT *, CASE WHEN s <= MAX(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                      THEN 0 ELSE 1 END AS o FROM c1),
c3 AS (SELECT *, SUM(o) OVER (PARTITION BY session_id ORDER BY s, e) AS g FROM c2),
zones AS (SELECT session_id, MIN(s) AS s, MAX(e) AS e FROM c3 GROUP BY session_id, g),
points AS (SELECT DISTINCT session_id, p FROM (SELECT session_id, unnest([s, e]) AS p FROM ivs
           UNION ALL SELECT session_id, unnest([s, e]) FROM zones)),
cells AS (SELECT session_id, p AS lo, LEAD(p) OVER (PARTITION BY session_id ORDER BY p) AS hi FROM points),
mids AS (SELECT session_id, lo, hi - lo AS d, (lo + hi) / 2 AS mid FROM cells WHERE hi - lo > 1e-9),
scored AS (SELECT m.* FROM mids m WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.session_id = m.session_id AND z.s <= m.mid AND m.mid < z.e)),
active AS (SELECT m.session_id, m.lo, m.d, i.side, i.speaker FROM scored m JOIN ivs i ON i.session_id = m.session_id AND i.s <= m.mid AND m.mid < i.e),
counts AS (SELECT session_id, lo, d, count(*) FILTER (side = 'r') AS nr, count(*) FILTER (side = 'h') AS nh FROM active GROUP BY ALL),
overlap AS (SELECT r.session_id, r.speaker AS ref, h.speaker AS hyp, SUM(r.d) AS shared_s
            FROM active r JOIN active h ON r.session_id = h.session_id AND r.lo = h.lo AND r.side = 'r' AND h.side = 'h' GROUP BY ALL)"""


SQL_HYP = """
hyp AS (SELECT session_id, start_s + 600 AS start_s, end_s + 600 AS end_s,
   CASE WHEN k % 10 = 0 THEN 'P' WHEN speaker = 'view' THEN 'USER' ELSE upper(substr(speaker, 1, 2)) END AS speaker FROM spoken)"""
SQL_DER = SQL_HYP + "," + sql_der("spoken", "hyp", COLLAR)

SQL_MAPPING = """

labels AS (SELECT session_id, side, list_sort(list(DISTINCT speaker)) AS l FROM ivs GROUP BY ALL),
sized AS (SELECT r.session_id, r.l AS refs, h.l AS hyps, len(r.l) > len(h.l) AS flip
          FROM labels r JOIN labels h ON r.session_id = h.session_id AND r.side = 'r' AND h.side = 'h'),
roles AS (SELECT session_id, flip, CASE WHEN flip THEN hyps ELSE refs END AS few, CASE WHEN flip THEN refs ELSE hyps END AS many FROM sized),
assign AS (
  SELECT session_id, flip, few, many, 0 AS i, []::BIGINT[] AS used, 0e0 AS score FROM roles
  UNION ALL
  SELECT a.session_id, a.flip, a.few, a.many, a.i + 1, list_append(a.used, j.j), a.score + COALESCE(o.shared_s, 0)
  FROM assign a JOIN LATERAL (SELECT unnest(range(1, len(a.many) + 1)) AS j) j ON NOT list_contains(a.used, j.j)
  LEFT JOIN overlap o ON o.session_id = a.session_id
    AND o.ref = CASE WHEN a.flip THEN a.many[j.j] ELSE a.few[a.i + 1] END
    AND o.hyp = CASE WHEN a.flip THEN a.few[a.i + 1] ELSE a.many[j.j] END
  WHERE a.i < len(a.few)),
chosen AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY round(score, 6) DESC, used) AS r FROM assign WHERE i = len(few)),
mapping AS (SELECT m.session_id, o.ref, o.hyp, o.shared_s FROM
   (SELECT session_id, CASE WHEN flip THEN many[used[n]] ELSE few[n] END AS ref, CASE WHEN flip THEN few[n] ELSE many[used[n]] END AS hyp
    FROM (SELECT *, unnest(range(1, len(few) + 1)) AS n FROM chosen WHERE r = 1)) m
   JOIN overlap o ON o.session_id = m.session_id AND o.ref = m.ref AND o.hyp = m.hyp AND o.shared_s > 0)"""
SQL_TOTALS = """,
totals AS (SELECT session_id, SUM(d * nr) AS total, SUM(d * greatest(0, nr - nh)) AS miss, SUM(d * greatest(0, nh - nr)) AS fa,
                  SUM(d * least(nr, nh)) AS paired FROM counts GROUP BY ALL),
correct AS (SELECT session_id, SUM(shared_s) AS c FROM mapping GROUP BY ALL)"""
SQL_MAPPED = SQL_DER + "," + SQL_MAPPING


def sides(spark, d):
    return ev.merged_sides(reference(spark, d), hypothesis(spark, d), DAY)


def cells(spark, d):
    both = sides(spark, d)
    zones = iv.no_score_collars(ev.side_of(both, "r"), ["case"], COLLAR, DAY)
    return both, ev.settle(ev.active_cells(both, zones, BUCKET_S), "cells")


@query(
    "no_score_collars",
    b.with_cte("activity", "spoken", recursive=True)
    + ","
    + SQL_DER
    + ' SELECT session_id AS "case", round(s, 6) AS start_s, round(e, 6) AS end_s FROM zones',
)
def no_score_collars(spark, d):
    zones = iv.no_score_collars(ev.side_of(sides(spark, d), "r"), ["case"], COLLAR, DAY)
    return zones.select("case", b.r6("start").alias("start_s"), b.r6("end").alias("end_s"))


@query(
    "elementary_cells",
    b.with_cte("activity", "spoken", recursive=True)
    + ","
    + SQL_DER
    + ' SELECT session_id AS "case", round(lo, 6) AS lo, round(hi, 6) AS hi FROM cells WHERE hi - lo > 1e-9',
)
def elementary_cells(spark, d):
    both = sides(spark, d)
    zones = ev.settle(iv.no_score_collars(ev.side_of(both, "r"), ["case"], COLLAR, DAY), "zones")
    ends = lambda df: df.select("case", F.explode(F.array("start", "end")).alias("point"))
    points = ends(both).unionByName(ends(zones))
    found = iv.elementary_cells(points, ["case"], chunk_s=DAY)
    return found.select("case", b.r6("lo").alias("lo"), b.r6("hi").alias("hi"))


@query(
    "co_active_time",
    b.with_cte("activity", "spoken", recursive=True)
    + ","
    + SQL_DER
    + ' SELECT session_id AS "case", ref, hyp, round(shared_s, 6) AS shared_s FROM overlap',
)
def co_active_time(spark, d):
    return ev.co_active(cells(spark, d)[1]).withColumn("shared_s", F.round("shared_s", 6))


@query(
    "label_mapping",
    b.with_cte("activity", "spoken", recursive=True) + "," + SQL_MAPPED + ' SELECT session_id AS "case", ref, hyp FROM mapping',
)
def label_mapping(spark, d):
    both, found = cells(spark, d)
    return ev.label_mapping(both, ev.co_active(found))


@query(
    "diarization_errors",
    b.with_cte("activity", "spoken", recursive=True)
    + ","
    + SQL_MAPPED
    + SQL_TOTALS
    + """
SELECT session_id AS "case", round((miss + fa + paired - COALESCE(c, 0)) / total, 6) AS der, round(miss, 6) AS miss_s,
       round(fa, 6) AS false_alarm_s, round(paired - COALESCE(c, 0), 6) AS confusion_s, round(total, 6) AS ref_speech_s
FROM totals LEFT JOIN correct USING (session_id)""",
)
def diarization_errors(spark, d):
    rows = ev.diarization_errors(
        reference(spark, d), hypothesis(spark, d), collar=COLLAR, bucket_s=BUCKET_S, chunk_s=DAY
    )
    return rows.select(
        "case",
        F.round("der", 6).alias("der"),
        *[F.round(c, 6).alias(c) for c in ("miss_s", "false_alarm_s", "confusion_s", "ref_speech_s")],
    )


@query(
    "wearer_attribution",
    b.with_cte("activity", "spoken", recursive=True)
    + ","
    + SQL_DER
    + """,
mine AS (SELECT 'r' AS side, session_id, s, e FROM ivs WHERE side = 'r' AND speaker = 'view'
         UNION ALL SELECT 'h', session_id, s, e FROM ivs WHERE side = 'h' AND speaker = 'USER'),
total AS (SELECT session_id, SUM(e - s) AS t FROM mine WHERE side = 'r' GROUP BY ALL),
hit AS (SELECT r.session_id, SUM(least(r.e, h.e) - greatest(r.s, h.s)) AS t FROM mine r JOIN mine h
        ON r.session_id = h.session_id AND r.side = 'r' AND h.side = 'h' AND r.s < h.e AND h.s < r.e GROUP BY ALL)
SELECT session_id AS "case", round(COALESCE(hit.t, 0) / total.t, 6) AS user_acc, round(total.t, 6) AS ref_user_s
FROM total LEFT JOIN hit USING (session_id)""",
)
def wearer_attribution(spark, d):
    ref = reference(spark, d).withColumn("speaker", F.when(F.col("speaker") == "view", "USER").otherwise(F.col("speaker")))
    rows = ev.wearer_attribution(ref, hypothesis(spark, d), bucket_s=BUCKET_S, chunk_s=DAY)
    return rows.select("case", b.r6("user_acc").alias("user_acc"), F.round("ref_user_s", 6).alias("ref_user_s"))


SQL_SUITE_WORDS = "totals AS (SELECT count(*) AS cases, count(*) FILTER (ref_words = 0) AS failed, sum(substitutions + insertions + deletions) AS errors, sum(ref_words) AS ref_words FROM scores)"


@query(
    "word_error_totals",
    "WITH RECURSIVE "
    + SQL_PAIRS
    + ","
    + SQL_SUITE_WORDS
    + " SELECT cases, failed, round(errors / ref_words, 6) AS wer, CAST(ref_words AS BIGINT) AS ref_words FROM totals",
)
def word_error_totals(spark, d):
    rows = ev.word_errors(pairs(spark, d))
    empty = [F.lit(None).cast("double").alias(c) for c in
             ("miss_s", "false_alarm_s", "confusion_s", "ref_speech_s", "user_acc", "ref_user_s")]
    totals = ev.suite_totals(rows.select("*", *empty))
    return totals.select("cases", "failed", b.r6("wer").alias("wer"), "ref_words")


def timed_segments(spark, d, shift: float):
    """Segments of every conversation, as labelled rows of one case."""
    return b.segments(spark, d).select(
        F.col("session_id").alias("case"),
        "pos",
        "text",
        (F.col("start") + shift).alias("start"),
        (F.col("end") + shift).alias("end"),
        F.when(F.col("speaker") == "user", "USER").otherwise(F.col("speaker")).alias("speaker"),
    )


SQL_SUITE = (
    """
labelled AS (SELECT session_id, pos, start_s, end_s, CASE speaker WHEN 'user' THEN 'USER' ELSE speaker END AS speaker FROM segments),
changed AS (SELECT *, CASE WHEN speaker = LAG(speaker) OVER (PARTITION BY session_id ORDER BY pos) THEN 0 ELSE 1 END AS o FROM labelled),
numbered AS (SELECT *, SUM(o) OVER (PARTITION BY session_id ORDER BY pos) AS g FROM changed),
ref AS (SELECT session_id, speaker, min(start_s) AS start_s, max(end_s) AS end_s FROM numbered GROUP BY session_id, speaker, g),
hyp AS (SELECT session_id, speaker, start_s + 2 AS start_s, end_s + 2 AS end_s FROM ref),"""
    + sql_der("ref", "hyp", 0.25)
    + ","
    + SQL_MAPPING
    + SQL_TOTALS
    + """,
users AS (SELECT session_id, SUM(e - s) AS t FROM ivs WHERE side = 'r' AND speaker = 'USER' GROUP BY ALL),
hits AS (SELECT r.session_id, SUM(least(r.e, h.e) - greatest(r.s, h.s)) AS t FROM ivs r JOIN ivs h ON r.session_id = h.session_id
   AND r.side = 'r' AND h.side = 'h' AND r.speaker = 'USER' AND h.speaker = 'USER' AND r.s < h.e AND h.s < r.e GROUP BY ALL),
counted AS (SELECT session_id, SUM(n) AS n FROM (SELECT conv_id AS session_id, len(list_filter(string_split(regexp_replace(regexp_replace(
   lower(nfc_normalize(text)), '\\(×\\d+\\)', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS n FROM conversations) GROUP BY ALL),
rows_ AS (SELECT c.session_id, n, 1 / n AS wer, (miss + fa + paired - COALESCE(c, 0)) / total AS der, miss + fa + paired - COALESCE(c, 0) AS wrong,
   total, COALESCE(hits.t, 0) / users.t AS user_acc, hits.t AS hit_s, users.t AS user_s
  FROM counted c LEFT JOIN totals USING (session_id) LEFT JOIN correct USING (session_id) LEFT JOIN users USING (session_id) LEFT JOIN hits USING (session_id))"""
)


def conversation_suite(spark, d):
    """All cases at once: a conversation against itself with one more word, two seconds late."""
    ref, hyp = timed_segments(spark, d, 0.0), timed_segments(spark, d, 2.0)
    texts = ev.hypothesis_text(ref, ref.select("case").distinct().withColumn("text", F.lit("")))
    both = texts.select(
        "case",
        F.lit(True).alias("verified"),
        F.col("hypothesis").alias("reference"),
        F.concat(F.lit("oui "), F.col("hypothesis")).alias("hypothesis"),
    )
    return ev.suite(both, ref, hyp)


@query(
    "evaluation_suite",
    b.with_cte("segments", recursive=True)
    + ","
    + SQL_SUITE
    + ' SELECT session_id AS "case", true AS verified, round(wer, 6) AS wer, round(der, 6) AS der, round(user_acc, 6) AS user_acc, CAST(NULL AS VARCHAR) AS error FROM rows_',
)
def evaluation_suite(spark, d):
    rows = conversation_suite(spark, d)
    return rows.select("case", "verified", *[b.r6(c).alias(c) for c in ("wer", "der", "user_acc")], "error")


@query(
    "evaluation_totals",
    b.with_cte("segments", recursive=True)
    + ","
    + SQL_SUITE
    + """ SELECT count(*) AS cases, 0 AS failed, round(count(*) / sum(n), 6) AS wer, round(sum(wrong) / sum(total), 6) AS der,
 round(sum(total), 5) AS ref_speech_s, round(sum(hit_s) / sum(user_s), 6) AS user_acc FROM rows_""",
)
def evaluation_totals(spark, d):
    totals = ev.suite_totals(conversation_suite(spark, d))
    return totals.select(
        "cases", "failed", *[b.r6(c).alias(c) for c in ("wer", "der", "user_acc")], F.round("ref_speech_s", 5).alias("ref_speech_s")
    )


@query(
    "known_names",
    b.with_cte("activity", "clusters", "voices")
    + """,
heard AS (SELECT event_type || ' ' || (k % 50) AS name, ts FROM activity),
own AS (SELECT name, 0 AS part, epoch_us(min(created_at)) AS ord FROM voices WHERE name IS NOT NULL GROUP BY ALL),
ranked AS (SELECT name, 1 AS part, -count(*) AS ord FROM heard GROUP BY ALL),
firsts AS (SELECT name, min({'part': part, 'ord': ord}) AS best FROM (SELECT * FROM own UNION ALL SELECT * FROM ranked) GROUP BY name)
SELECT name, best.part AS part FROM firsts ORDER BY best.part, best.ord, name LIMIT 15""",
)
def known_names(spark, d):
    heard = b.activity(spark, d).select(
        F.concat("event_type", F.lit(" "), (F.col("k") % 50).cast("string")).alias("name"),
        F.col("ts").alias("mentioned_at"),
    )
    return ev.known_names(b.voices(spark, d), heard).select("name", "part")


@query(
    "case_names",
    """
SELECT doc_id, CAST(strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id AS INTEGER)), '%Y-%m-%d') || '-' || substr(source, 1, 8) AS VARCHAR) AS case_name,
       regexp_full_match(source || '/' || lang, '[A-Za-z0-9][A-Za-z0-9._-]{0,80}') AS slash_ok,
       regexp_full_match(source || '.' || lang, '[A-Za-z0-9][A-Za-z0-9._-]{0,80}') AS dot_ok
FROM documents""",
)
def case_names(spark, d):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("doc_id").cast("int"))
    return given(spark, d, "documents").select(
        "doc_id",
        ev.default_case_name(at, F.col("source")).alias("case_name"),
        ev.valid_case_name(F.concat_ws("/", "source", "lang")).alias("slash_ok"),
        ev.valid_case_name(F.concat_ws(".", "source", "lang")).alias("dot_ok"),
    )


def cases(spark, d):
    """Documents as cases: verified where labelled good, settings by language."""
    snapshot = lambda temperature: F.create_map(
        F.lit("language"), F.col("lang"), F.lit("temperature"), temperature
    )
    docs = given(spark, d, "documents").join(given(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("case"),
        "lang",
        (F.col("quality") == 1).alias("verified"),
        ev.fingerprint(snapshot(F.lit("0"))).alias("fingerprint"),
        ev.fingerprint(snapshot((F.col("doc_id") % 2).cast("string"))).alias("cached_fingerprint"),
    )


@query(
    "unverified_cases",
    'SELECT doc_id AS "case" FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1',
)
def unverified_cases(spark, d):
    return ev.unverified(cases(spark, d)).select("case")


@query(
    "cached_hypotheses",
    'SELECT doc_id AS "case", doc_id % 2 = 0 AS reused FROM documents',
)
def cached_hypotheses(spark, d):
    rows = cases(spark, d)
    cache = rows.select("case", F.col("cached_fingerprint").alias("fingerprint"))
    hit, miss = ev.reusable(rows.select("case", "fingerprint"), cache)
    return hit.select("case", F.lit(True).alias("reused")).unionByName(miss.select("case", F.lit(False).alias("reused")))


@query(
    "unknown_cases",
    'SELECT DISTINCT doc_id AS "case" FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = \'en\')',
)
def unknown_cases(spark, d):
    wanted = given(spark, d, "labels").select(F.col("doc_id").alias("case"))
    known = given(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("case"))
    return ev.unknown_cases(wanted, known)


@query(
    "cases_with_metrics",
    'SELECT doc_id AS "case", COALESCE(quality = 1, false) AS verified, round(CASE WHEN quality IS NOT NULL THEN doc_id / 7e0 END, 6) AS wer FROM documents LEFT JOIN labels USING (doc_id)',
)
def cases_with_metrics(spark, d):
    from parlance.sources.evalfiles import with_latest

    listed = cases(spark, d).select("case", F.coalesce("verified", F.lit(False)).alias("verified"))
    metrics = given(spark, d, "labels").select(F.col("doc_id").alias("case"), (F.col("doc_id") / F.lit(7.0)).alias("wer"))
    return with_latest(listed, metrics).select("case", "verified", b.r6("wer").alias("wer"))


@query(
    "vocabulary_prompt",
    b.with_cte("activity")
    + """,
heard AS (SELECT event_type || ' ' || (k % 50) AS name, count(*) AS n FROM activity GROUP BY ALL),
top AS (SELECT name, n FROM heard ORDER BY n DESC, name LIMIT 15)
SELECT 'Hello. ' || string_agg(name, ', ' ORDER BY n DESC, name) || '.' AS prompt FROM top""",
)
def vocabulary_prompt(spark, d):
    heard = b.activity(spark, d).select(
        F.concat("event_type", F.lit(" "), (F.col("k") % 50).cast("string")).alias("name"),
        F.col("ts").alias("mentioned_at"),
    )
    nobody = heard.limit(0).select("name", F.col("mentioned_at").alias("created_at"))
    return ev.vocabulary_prompt("Hello. ", ev.known_names(nobody, heard))


@query(
    "spoken_languages",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fr' WHEN doc_id % 3 = 1 THEN lang ELSE 'auto' END AS language FROM documents",
)
def spoken_languages(spark, d):
    configured = F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("auto")
    hint = F.when(F.col("doc_id") % 3 == 1, F.col("lang")).otherwise("")
    return given(spark, d, "documents").select("doc_id", ev.spoken_language(configured, hint).alias("language"))


@query(
    "case_drafts",
    b.with_cte("segments")
    + """
SELECT '2024-01-0' || (1 + session_id % 9) || '-' || session_id AS "case", pos, round_even(start_s, 2) AS start_s, trim(text) AS text, speaker FROM segments""",
)
def case_drafts(spark, d):
    return drafted(spark, d)[0].select(
        "case", "pos", F.col("start").alias("start_s"), "text", "speaker"
    )


@query(
    "written_case_turns",
    b.with_cte("segments")
    + """
SELECT '2024-01-0' || (1 + session_id % 9) || '-' || session_id AS "case", pos, round_even(start_s, 2) AS start_s, trim(text) AS text, speaker FROM segments""",
)
def written_case_turns(spark, d):
    """Drafts as files and back."""
    folder = shared_path(spark, "cases")
    evalfiles.write_reference(drafted(spark, d)[0], folder)
    return evalfiles.read_reference(spark, folder).select("case", "pos", F.col("start").alias("start_s"), "text", "speaker")


@query(
    "refused_cases",
    b.with_cte("segments")
    + """
SELECT session_id, CASE WHEN session_id % 7 = 0 THEN 'audio is gone' WHEN session_id % 7 = 1 THEN 'no transcript yet' END AS reason
FROM segments WHERE session_id % 7 < 2 GROUP BY session_id
UNION ALL SELECT -1 - session_id, 'transcript is empty' FROM segments GROUP BY session_id""",
)
def refused_cases(spark, d):
    """Sessions that cannot become a case, with the reason; of each there is a twin whose transcript is blank."""
    rows = b.segments(spark, d)
    sessions = rows.select("session_id").distinct().select(
        "session_id",
        b.at("2024-01-01 00:00:00").alias("started_at"),
        F.when(F.col("session_id") % 7 != 0, "/audio/x.ogg").alias("audio_path"),
        F.when(F.col("session_id") % 7 != 1, "").alias("text"),
    )
    blank = sessions.select((-1 - F.col("session_id")).alias("session_id"), "started_at", F.lit("/audio/x.ogg").alias("audio_path"), F.lit(" ").alias("text"))
    return ev.case_drafts(sessions.unionByName(blank), rows)[1].select("session_id", "reason")


@query(
    "case_folders",
    b.with_cte("segments")
    + """
SELECT '2024-01-0' || (1 + session_id % 9) || '-' || session_id AS "case", count(*) AS n_turns, session_id % 2 = 0 AS verified,
       md5(string_agg(trim(text), chr(10) ORDER BY round_even(start_s, 2), pos)) AS reference_md5, '.parquet' AS audio_suffix FROM segments GROUP BY session_id""",
)
def case_folders(spark, d):
    """Drafts written as case folders and loaded again; a small table of the input stands for the audio."""
    turns = drafted(spark, d)[0]
    number = F.substring_index("case", "-", -1).cast("long")
    facts = turns.select("case").distinct().select(
        "case", F.lit(f"{d}/region.parquet").alias("audio_path"),
        F.create_map(F.lit("verified"), (number % 2 == 0).cast("string"), F.lit("notes"), F.lit("")).alias("meta"),
    )
    folder = shared_path(spark, "case-folders")
    casefolders.write_cases(turns, facts, folder)
    return evalfiles.load_cases(spark, folder).select(
        "case", F.size("turns").cast("long").alias("n_turns"), "verified", F.md5("reference").alias("reference_md5"),
        F.regexp_extract("audio_path", r"(\.[a-z]+)$", 1).alias("audio_suffix"),
    )


def drafted(spark, d):
    rows = b.segments(spark, d)
    sessions = rows.select("session_id").distinct().select(
        "session_id",
        (b.at("2024-01-01 00:00:00") + F.make_dt_interval((F.col("session_id") % 9).cast("int"))).alias("started_at"),
        F.lit("/audio/x.ogg").alias("audio_path"),
        F.lit("").alias("text"),
    )
    return ev.case_drafts(sessions, rows)
