"""Queries: day digests and stored summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.plans import daily as dy

ZONE = "Etc/GMT-2"  # two hours ahead of UTC, all year

SQL_CHOSEN = """
chosen AS (SELECT *, CAST(started_at + INTERVAL 2 HOUR AS DATE) AS day, COALESCE(quality_override, quality_score) AS quality
           FROM conv WHERE COALESCE(quality_override, quality_score) >= 0.3)"""


def chosen(spark, d):
    return dy.eligible(b.conv(spark, d), ZONE, 0.3)


@query(
    "daily_eligible",
    b.with_cte("conv") + "," + SQL_CHOSEN + " SELECT user_id, strftime(day, '%Y-%m-%d') AS day, id FROM chosen",
)
def daily_eligible(spark, d):
    return chosen(spark, d).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "id")


@query(
    "daily_eligible_summer_time",
    b.with_cte("conv")
    + """
SELECT id FROM conv WHERE user_id LIKE 'src%' AND COALESCE(quality_override, quality_score) >= 0.5
AND timezone('UTC', timezone('Europe/Paris', TIMESTAMP '2024-01-10 00:00:00')) <= started_at
AND started_at < timezone('UTC', timezone('Europe/Paris', TIMESTAMP '2024-01-11 00:00:00'))""",
)
def daily_eligible_summer_time(spark, d):
    return dy.eligible(b.conv(spark, d), "Europe/Paris", 0.5, day="2024-01-10").select("id")


@query(
    "digest_lines",
    b.with_cte("activity", "conv", "cal", "tasks", "mentions")
    + ","
    + SQL_CHOSEN
    + """,
kids AS (
  SELECT conversation_id, 2 AS part, '  events:' AS header, id AS item, '    - ' || title || COALESCE(strftime(starts_at, ' %Y-%m-%d %H:%M'), '') AS line FROM cal
  UNION ALL SELECT conversation_id, 4, '  open action items:', id, '    - ' || text || COALESCE(' (' || owner || ')', '') FROM tasks WHERE status = 'open'
  UNION ALL SELECT conversation_id, 6, '  people mentioned:', id, '    - ' || name FROM mentions),
lines_ AS (
  SELECT id AS conversation_id, 0 AS part, 0 AS item,
         strftime(started_at + INTERVAL 2 HOUR, '[%H:%M] ') || COALESCE(NULLIF(title, ''), '(untitled)') || ': ' || COALESCE(summary, '(no summary)') AS line FROM chosen
  UNION ALL SELECT DISTINCT conversation_id, part - 1, 0, header FROM kids
  UNION ALL SELECT conversation_id, part, item, line FROM kids)
SELECT c.user_id, strftime(c.day, '%Y-%m-%d') AS day, l.conversation_id, l.part, l.item, l.line
FROM lines_ l JOIN chosen c ON c.id = l.conversation_id""",
)
def digest_lines(spark, d):
    rows = dy.digest_lines(chosen(spark, d), b.cal(spark, d), b.tasks(spark, d), b.mentions(spark, d), ZONE)
    return rows.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "conversation_id", "part", "item", "line")


SQL_SUMMARIES = """
summaries AS (SELECT user_id, strftime(day, '%Y-%m-%d') AS date, count(*) AS conversation_count FROM chosen GROUP BY ALL)"""


def summaries(spark, d, threshold):
    rows = dy.summary_members(dy.eligible(b.conv(spark, d), ZONE, threshold))
    return rows.groupBy("user_id", "date").agg(F.count("*").alias("conversation_count"))


@query(
    "stored_summaries",
    b.with_cte("conv")
    + ","
    + SQL_CHOSEN
    + ","
    + SQL_SUMMARIES
    + """,
strict AS (SELECT user_id, strftime(day, '%Y-%m-%d') AS date, count(*) AS n FROM chosen WHERE quality >= 0.7 GROUP BY ALL)
SELECT user_id, date, COALESCE(s.n, o.conversation_count) AS conversation_count, s.n IS NOT NULL AS replaced
FROM summaries o FULL JOIN strict s USING (user_id, date)""",
)
def stored_summaries(spark, d):
    old = summaries(spark, d, 0.3).withColumn("replaced", F.lit(False))
    new = summaries(spark, d, 0.7).withColumn("replaced", F.lit(True))
    return dy.stored(old, new)


@query(
    "summary_drift",
    b.with_cte("conv")
    + """,
m AS (SELECT user_id, strftime(CAST(started_at + INTERVAL 2 HOUR AS DATE), '%Y-%m-%d') AS date,
             quality_score >= 0.5 AS old, COALESCE(quality_override, quality_score) >= 0.5 AS new FROM conv)
SELECT user_id, date, count(*) FILTER (old) AS n_cached, count(*) FILTER (new) AS n_current, count(*) FILTER (old <> new) AS n_changed
FROM m GROUP BY ALL HAVING count(*) FILTER (old) > 0 AND count(*) FILTER (old <> new) > 0""",
)
def summary_drift(spark, d):
    rows = b.conv(spark, d)
    cached = dy.eligible(rows.withColumn("quality_override", F.lit(None).cast("double")), ZONE, 0.5)
    return dy.drift(dy.summary_members(cached), dy.summary_members(dy.eligible(rows, ZONE, 0.5)))


@query(
    "recent_summaries",
    b.with_cte("conv")
    + ","
    + SQL_CHOSEN
    + ","
    + SQL_SUMMARIES
    + " SELECT date, conversation_count FROM summaries WHERE user_id = 'src3' ORDER BY date DESC LIMIT 14",
)
def recent_summaries(spark, d):
    return dy.recent_summaries(summaries(spark, d, 0.3), "src3").select("date", "conversation_count")
