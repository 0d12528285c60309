"""Calendar feeds as text: events in long form, one ordered feed per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.ical import escaped, folded, utc_stamp
from parlance.functions.text import cap, strip

CRLF = "\r\n"


def event_blocks(events: DataFrame, stamped_at: str, domain: str = "parlance") -> DataFrame:
    """One ``block`` of calendar lines per event with a start.

    ``events``: ``id, title, description, starts_at, ends_at, location, confidence,
    conversation_id, conversation_title``.  Without an end an event lasts an hour.
    """
    shown = lambda c: F.nullif(F.col(c), F.lit(""))
    percent = F.bround(F.col("confidence") * 100, 0).cast("int").cast("string")
    description = F.concat_ws(
        "\n",
        shown("description"),
        F.concat(F.lit("confidence: "), percent, F.lit("%")),
        F.concat(F.lit("from: "), shown("conversation_title")),
        F.concat(F.lit("conversation: "), F.col("conversation_id").cast("string")),
    )
    ends = F.coalesce("ends_at", F.col("starts_at") + F.expr("INTERVAL 1 HOUR"))
    block = F.concat_ws(
        CRLF,
        F.lit("BEGIN:VEVENT"),
        folded(F.concat(F.lit("UID:"), F.col("id").cast("string"), F.lit(f"@{domain}"))),
        F.concat(F.lit("DTSTAMP:"), utc_stamp(F.lit(stamped_at).cast("timestamp"))),
        F.concat(F.lit("DTSTART:"), utc_stamp(F.col("starts_at"))),
        F.concat(F.lit("DTEND:"), utc_stamp(ends)),
        folded(F.concat(F.lit("SUMMARY:"), escaped(F.coalesce(shown("title"), F.lit("(untitled)"))))),
        folded(F.concat(F.lit("LOCATION:"), F.when(shown("location").isNotNull(), escaped(F.col("location"))))),
        folded(F.concat(F.lit("DESCRIPTION:"), escaped(description))),
        F.lit("END:VEVENT"),
    )
    return events.filter(F.col("starts_at").isNotNull()).select("id", "conversation_id", "starts_at", block.alias("block"))


def header(name: str, product: str) -> Column:
    """The lines before the first event."""
    return F.concat_ws(
        CRLF,
        F.lit("BEGIN:VCALENDAR"),
        F.lit("VERSION:2.0"),
        folded(F.lit(f"PRODID:{product}")),
        F.lit("CALSCALE:GREGORIAN"),
        F.lit("METHOD:PUBLISH"),
        folded(F.concat(F.lit("X-WR-CALNAME:"), escaped(F.lit(name)))),
    )


def feed(
    events: DataFrame, stamped_at: str, name: str = "parlance", product: str = "-//parlance//EN",
    min_confidence: float = 0.0,
) -> DataFrame:
    """Rows of one feed in order: ``part, starts_at, id, block`` (header, events, footer)."""
    chosen = event_blocks(events.filter(F.col("confidence") >= min_confidence), stamped_at)
    body = chosen.select(F.lit(1).alias("part"), "starts_at", F.col("id").cast("string").alias("id"), "block")
    frame = events.sparkSession.range(1).select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), header(name, product).alias("block")),
                F.struct(F.lit(2).alias("part"), F.lit("END:VCALENDAR").alias("block")),
            )
        ).alias("f")
    ).select("f.part", F.lit(None).cast("timestamp").alias("starts_at"), F.lit("").alias("id"), "f.block")
    return body.unionByName(frame)


def write_feed(rows: DataFrame, path: str) -> None:
    """Write a feed as text with CRLF line ends; the part files in name order are the feed."""
    order = ["part", "starts_at", "id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("block").alias("value")).write.option(
        "lineSep", CRLF
    ).text(path)


def single_event(events: DataFrame, stamped_at: str, name: str = "parlance", product: str = "-//parlance//EN") -> DataFrame:
    """A calendar of its own per event, with its file name: ``id, file_name, content``."""
    kept = cap(F.regexp_replace(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("event")), r"[^\p{L}\p{N} _-]", ""), 60)
    safe = F.coalesce(F.nullif(F.replace(strip(kept), F.lit(" "), F.lit("_")), F.lit("")), F.lit("event"))
    titles = events.select("id", F.concat(safe, F.lit("-"), F.col("id").cast("string"), F.lit(".ics")).alias("file_name"))
    blocks = event_blocks(events, stamped_at).select("id", "block")
    content = F.concat_ws(CRLF, header(name, product), F.col("block"), F.lit("END:VCALENDAR"), F.lit(""))
    return blocks.join(titles, "id").select("id", "file_name", content.alias("content"))
