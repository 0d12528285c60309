"""Column expressions over numbers, times and display forms."""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codec to media type.
MEDIA_TYPES = {
    "opus": "audio/ogg",
    "ogg": "audio/ogg",
    "wav": "audio/wav",
    "mp3": "audio/mpeg",
    "m4a": "audio/mp4",
    "flac": "audio/flac",
    "webm": "audio/webm",
}


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def confidence(raw: Column) -> Column:
    """Text or number to 0..1; anything unreadable (also NaN) counts as 0.5."""
    return F.coalesce(score_or_null(raw), F.lit(0.5))


def score_or_null(raw: Column) -> Column:
    """Text or number to 0..1; anything unreadable or NaN is null."""
    number = raw.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), clamp(number, 0.0, 1.0))


def iso_timestamp(raw: Column) -> Column:
    """ISO-8601 text to an instant; anything else is null.  No offset means UTC."""
    text = F.trim(raw)
    pattern = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})([.,]\d{1,9})?)?)?(Z|z|[+-]\d{2}(?::?\d{2})?)?)?$"
    week = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(?=$|[T ])"
    # a week date becomes its calendar day: the Monday of the week of 4 January, plus weeks and days
    monday = F.date_trunc("week", F.make_date(F.regexp_extract(text, week, 1).try_cast("int"), F.lit(1), F.lit(4))).cast("date")
    shift = (F.regexp_extract(text, week, 2).try_cast("int") - 1) * 7 + F.coalesce(F.regexp_extract(text, week, 3).try_cast("int"), F.lit(1)) - 1
    real = F.regexp_extract(text, week, 2).try_cast("int").between(1, 53)
    text = F.when(text.rlike(week) & real, F.concat(F.date_add(monday, shift).cast("string"), F.regexp_replace(text, week, ""))).otherwise(text)
    part = lambda i: F.regexp_extract(text, pattern, i)
    or_zero = lambda i: F.when(part(i) == "", F.lit("00")).otherwise(part(i))
    offset = F.regexp_replace(F.upper(part(8)), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    offset = F.when(part(8) == "", F.lit("Z")).when(offset.endswith(":"), F.concat(offset, F.lit("00"))).otherwise(offset)
    clock = F.concat(or_zero(4), F.lit(":"), or_zero(5), F.lit(":"), or_zero(6), F.translate(part(7), ",", "."))
    whole = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), clock, offset)
    return F.when(text.rlike(pattern), whole.try_cast("timestamp"))


def iso_date(raw: Column) -> Column:
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date"))


def shown_time(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm"), F.lit(""))


def shown_date(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit(""))


def shown_duration(seconds: Column) -> Column:
    """``12.3s``, ``4m 05s`` or ``1h 02m``; nothing for no duration."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("long")
    return (
        F.when(seconds.isNull() | (seconds == 0), F.lit(""))
        .when(seconds < 60, F.format_string("%.1fs", F.bround(seconds, 1)))
        .when(minutes < 60, F.format_string("%dm %02ds", minutes, whole % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(minutes / 60).cast("long"), minutes % 60))
    )


def shown_bytes(n: Column) -> Column:
    """Whole bytes, else one decimal of the largest fitting unit."""
    shown = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    size = n.cast("double")
    for unit in ("KB", "MB", "GB", "TB"):
        size = size / 1024
        shown = shown.when(size < 1024, F.format_string(f"%.1f {unit}", F.bround(size, 1)))
    return shown.otherwise(F.format_string("%.1f PB", F.bround(size / 1024, 1)))


def codec_of(path: Column) -> Column:
    """The file suffix in lower case; ``bin`` without one."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit("")), F.lit("bin"))


def media_type_of(codec: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in MEDIA_TYPES.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, codec), F.lit("application/octet-stream"))


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """First instant of a local day and of the next one (23 or 25 hours at clock changes)."""
    start = day.cast("timestamp")
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def known_zone(zone: str) -> str:
    """The zone, or UTC where there is none of that name."""
    try:
        ZoneInfo(zone)
    except (ValueError, OSError, KeyError):
        return "UTC"
    return zone


def local_day(instant: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, known_zone(zone)))


def neighbour_days(day: Column) -> tuple[Column, Column]:
    """The day before and the day after."""
    return F.date_sub(day, 1), F.date_add(day, 1)


def after_seconds(start: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + F.round(seconds * 1e6).cast("long"))
