"""Interval algebra: overlap, union, turns, complements, elementary cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.scans import Scan, interval_islands, island_ids, prefix_scan
from parlance.session import settle

HOUR = 3600.0


def time_chunk(column: str | Column, width_s: float = HOUR) -> Column:
    """The time bucket that cuts a long key into scan chunks."""
    value = F.col(column) if isinstance(column, str) else column
    return F.floor(value / F.lit(width_s))


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def valid(df: DataFrame) -> DataFrame:
    """Rows with a speaker and a positive length; a missing end equals the start."""
    start = F.coalesce(F.col("start"), F.lit(0.0))
    end = F.coalesce(F.nullif(F.col("end"), F.lit(0.0)), start)
    return df.withColumns({"start": start, "end": end}).filter(
        F.col("speaker").isNotNull() & (F.col("speaker") != "") & (F.col("end") > F.col("start"))
    )


def union_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", chunk_s: float = HOUR
) -> DataFrame:
    """Merge overlapping or touching intervals per key."""
    islands = interval_islands(
        df.select(*keys, start, end), keys, time_chunk(start, chunk_s), start, end, lambda gap: gap > 0
    )
    return islands.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def turns(
    segments: DataFrame,
    keys: Sequence[str] = ("session_id",),
    gap_tolerance_s: float = 1.0,
    chunk_s: float = HOUR,
) -> DataFrame:
    """Fold same-speaker neighbours whose gap is at most the tolerance into turns."""
    keys = list(keys)
    rows = valid(segments).select(*keys, "start", "end", "speaker")
    runs = island_ids(
        rows,
        keys,
        time_chunk("start", chunk_s),
        ["start", "end", "speaker"],
        ["speaker"],
        lambda prev, cur: prev["speaker"] != cur["speaker"],
        name="run",
    )
    folded = interval_islands(
        settle(runs, "runs"),
        [*keys, "run", "speaker"],
        time_chunk("start", chunk_s),
        "start",
        "end",
        lambda gap: gap > gap_tolerance_s,
    )
    return (
        folded.groupBy(*keys, "run", "speaker", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(*keys, "start", "end", "speaker")
    )


def elementary_cells(points: DataFrame, keys: Sequence[str], chunk_s: float = HOUR, eps: float = 1e-9) -> DataFrame:
    """Neighbouring pairs of the distinct boundary points of each key: ``lo, hi``."""
    distinct = points.select(*keys, "point").distinct()
    paired = prefix_scan(
        distinct,
        keys,
        time_chunk("point", chunk_s),
        ["point"],
        {"lo": Scan("last", F.col("point"), inclusive=False)},
    )
    return paired.filter(F.col("point") - F.col("lo") > eps).select(*keys, "lo", F.col("point").alias("hi"))


def no_score_collars(
    reference: DataFrame, keys: Sequence[str], collar: float, chunk_s: float = HOUR
) -> DataFrame:
    """The zones of ``collar`` seconds around every distinct reference edge, merged."""
    edges = reference.select(*keys, F.explode(F.array("start", "end")).alias("edge")).distinct()
    zones = edges.select(
        *keys, (F.col("edge") - collar).alias("start"), (F.col("edge") + collar).alias("end")
    )
    return union_intervals(zones, keys, chunk_s=chunk_s)


def cut_at_buckets(df: DataFrame, width_s: float, start: str = "start", end: str = "end") -> DataFrame:
    """Split intervals at bucket borders, so that each ``bucket`` can be handled alone."""
    first = F.floor(F.col(start) / width_s)
    last = F.greatest(first, F.ceil(F.col(end) / width_s) - 1)
    pieces = df.withColumn("bucket", F.explode(F.sequence(first, last)))
    return pieces.withColumns(
        {
            start: F.greatest(F.col(start), F.col("bucket") * width_s),
            end: F.least(F.col(end), (F.col("bucket") + 1) * width_s),
        }
    )


def in_buckets(df: DataFrame, width_s: float, start: str = "start", end: str = "end") -> DataFrame:
    """Copy each interval, unchanged, into every bucket that it touches."""
    first = F.floor(F.col(start) / width_s)
    last = F.greatest(first, F.ceil(F.col(end) / width_s) - 1)
    return df.withColumns({"first_bucket": first, "bucket": F.explode(F.sequence(first, last))})


def clip_for_embedding(
    segments: DataFrame, max_s: float = 10.0, min_s: float = 0.5
) -> DataFrame:
    """Keep the middle ``max_s`` seconds of each labelled segment; drop short ones."""
    length = F.col("end") - F.col("start")
    kept = segments.filter(F.col("speaker").isNotNull() & (F.col("speaker") != "") & (length >= min_s))
    start = F.when(length > max_s, F.col("start") + (length - max_s) / 2).otherwise(F.col("start"))
    end = F.when(length > max_s, F.col("start") + (length - max_s) / 2 + max_s).otherwise(F.col("end"))
    return kept.withColumns({"clip_start": start, "clip_end": end})
