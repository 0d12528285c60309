"""Daily digests: eligible conversations, digest lines, stored summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.values import local_day
from parlance.plans.archive import effective_quality

OPEN = "open"


def eligible(conversations: DataFrame, zone: str, threshold: float = 0.3, user: str | None = None, day: str | None = None) -> DataFrame:
    """Conversations that count for the digest of their local day, any user and day.

    Days follow the zone's clock, so they last 23 or 25 hours when it changes.
    """
    rows = conversations if user is None else conversations.filter(F.col("user_id") == user)
    if day is not None:  # plain bounds on the stored column reach the scan
        start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone)
        end = F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), 1).cast("timestamp"), zone)
        rows = rows.filter((F.col("started_at") >= start) & (F.col("started_at") < end))
    return rows.withColumns(
        {"day": local_day(F.col("started_at"), zone), "quality": effective_quality()}
    ).filter(F.col("quality") >= threshold)


def digest_lines(
    chosen: DataFrame, events: DataFrame, actions: DataFrame, mentions: DataFrame, zone: str
) -> DataFrame:
    """Lines of the day digests: ``user_id, day, started_at, conversation_id, part, item, line``.

    In the order of these columns they read as one block per conversation: a head line, its
    events, its open actions and the people mentioned.  Long form keeps a busy day spread
    over many tasks.
    """
    heads = chosen.select("user_id", "day", "started_at", F.col("id").alias("conversation_id"), "title", "summary")
    place = ["user_id", "day", "started_at", "conversation_id"]
    clock = F.date_format(F.from_utc_timestamp("started_at", zone), "HH:mm")
    named = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    zero = F.lit(0).cast("long")
    first = heads.select(
        *place,
        F.lit(0).alias("part"),
        zero.alias("item"),
        F.concat(F.lit("["), clock, F.lit("] "), named("title", "(untitled)"), F.lit(": "), named("summary", "(no summary)")).alias("line"),
    )

    def section(children: DataFrame, part: int, header: str, line) -> DataFrame:
        mine = children.select("conversation_id", "id", line.alias("line")).join(heads.select(*place), "conversation_id")
        rows = mine.select(*place, F.lit(part).alias("part"), F.col("id").cast("long").alias("item"), "line")
        top = mine.select(*place).distinct().select(
            *place, F.lit(part - 1).alias("part"), zero.alias("item"), F.lit(header).alias("line")
        )
        return top.unionByName(rows)

    when = F.coalesce(F.concat(F.lit(" "), F.date_format("starts_at", "yyyy-MM-dd HH:mm")), F.lit(""))
    owner = F.coalesce(F.concat(F.lit(" ("), F.nullif(F.col("owner"), F.lit("")), F.lit(")")), F.lit(""))
    return (
        first.unionByName(section(events, 2, "  events:", F.concat(F.lit("    - "), "title", when)))
        .unionByName(
            section(
                actions.filter(F.col("status") == OPEN), 4, "  open action items:", F.concat(F.lit("    - "), "text", owner)
            )
        )
        .unionByName(section(mentions, 6, "  people mentioned:", F.concat(F.lit("    - "), "name")))
    )


def write_digests(lines: DataFrame, path: str, tasks: int | None = None) -> None:
    """Write the lines in reading order as text, partitioned by user and day.

    Rows are range-partitioned over the full order, so one huge day spans several files.
    """
    order = ["user_id", "day", "started_at", "conversation_id", "part", "item"]
    spread = lines.repartitionByRange(tasks, *order) if tasks else lines.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).select("user_id", "day", F.col("line").alias("value")).write.partitionBy(
        "user_id", "day"
    ).text(path)


def summary_members(chosen: DataFrame) -> DataFrame:
    """The conversations behind each day's summary, in long form."""
    return chosen.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("date"), F.col("id").alias("conversation_id"))


def stored(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Summaries after a run: one row per user and date, new rows replace old ones."""
    return existing.join(new.select("user_id", "date"), ["user_id", "date"], "left_anti").unionByName(new)


def drift(cached: DataFrame, current: DataFrame) -> DataFrame:
    """User-days whose cached conversations are no longer the current ones.

    Both sides are in long form.  A day without cached conversations does not count.
    """
    keys = ["user_id", "date", "conversation_id"]
    sides = cached.select(*keys, F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        current.select(*keys, F.lit(0).alias("old"), F.lit(1).alias("new"))
    )
    ids = sides.groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return (
        ids.groupBy("user_id", "date")
        .agg(
            F.sum("old").alias("n_cached"),
            F.sum("new").alias("n_current"),
            F.count_if(F.col("old") != F.col("new")).alias("n_changed"),
        )
        .filter((F.col("n_cached") > 0) & (F.col("n_changed") > 0))
    )


def recent_summaries(summaries: DataFrame, user: str, n: int = 14) -> DataFrame:
    return summaries.filter(F.col("user_id") == user).orderBy(F.desc("date")).limit(n)
