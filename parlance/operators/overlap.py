"""Intervals against intervals by sweeps along time: no inequality join, no list of pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.intervals import in_buckets, time_chunk
from parlance.operators.scans import Scan, prefix_scan
from parlance.session import parallelism, settle


class _Open:
    """Open intervals of one side, columns in arrays; ended ones are let go once they are half of them."""

    def __init__(self, columns: int):
        self.rows, self.end, self.cells = 0, np.zeros(64), np.zeros((columns, 64))
        self.names: list = []

    def add(self, end: float, cells: tuple, name) -> None:
        if self.rows == len(self.end):
            self.end = np.concatenate([self.end, np.zeros(self.rows)])
            self.cells = np.concatenate([self.cells, np.zeros_like(self.cells)], axis=1)
        self.end[self.rows], self.cells[:, self.rows] = end, cells
        self.names.append(name)
        self.rows += 1

    def live(self, at: float) -> np.ndarray:
        """Places of the intervals that end after ``at``."""
        return np.flatnonzero(self.end[: self.rows] > at)

    def let_go(self, at: float, ended: list | None = None) -> None:
        """Drop the intervals that have ended by ``at``, if they are many; ``ended`` takes them."""
        kept = self.live(at)
        if 2 * len(kept) > self.rows or self.rows < 64 and at < np.inf:
            return
        if ended is not None:
            gone = np.flatnonzero(self.end[: self.rows] <= at)
            ended.extend((self.names[i], *self.cells[:, i].tolist()) for i in gone)
        self.end[: len(kept)], self.cells[:, : len(kept)] = self.end[kept], self.cells[:, kept]
        self.names = [self.names[i] for i in kept]
        self.rows = len(kept)


class _Sweep:
    """Segments and turns of one bucket in order of their starts; of each segment the turn with the greatest overlap so far."""

    def __init__(self) -> None:
        self.turns = _Open(1)  # start; name: number of the speaker
        self.segments = _Open(5)  # start; length, start, end and speaker of the best turn; name: position
        self.speakers: list = []
        self.ended: list = []
        self.steps = 0

    def turn(self, start: float, end: float, speaker) -> None:
        live = self.segments.live(start)
        cells = self.segments.cells
        live = live[cells[0, live] < end]
        if len(live):
            length = np.maximum(0.0, np.minimum(self.segments.end[live], end) - start)
            best, since, until = cells[1, live], cells[2, live], cells[3, live]
            better = (length > best) | ((length == best) & ((start < since) | ((start == since) & (end < until))))
            at = live[better]
            cells[1, at], cells[2, at], cells[3, at], cells[4, at] = length[better], start, end, len(self.speakers)
        self.turns.add(end, (start,), len(self.speakers))
        self.speakers.append(speaker)
        self._tidy(start)

    def segment(self, start: float, end: float, position) -> None:
        best = (-1.0, 0.0, 0.0, -1.0)
        live = self.turns.live(start)
        if len(live):
            since, until = self.turns.cells[0, live], self.turns.end[live]
            length = np.minimum(until, end) - start
            first = np.lexsort((until, since, -length))[0] if len(live) > 1 else 0
            best = (length[first], since[first], until[first], self.turns.names[live[first]])
        self.segments.add(end, (start, *best), position)
        self._tidy(start)

    def _tidy(self, at: float) -> None:
        self.steps += 1
        if self.steps % 64 == 0:
            self.turns.let_go(at)
            self.segments.let_go(at, self.ended)

    def take(self, all_: bool) -> list[tuple]:
        """Position, length, start, end and speaker for the segments that have ended and met a turn."""
        if all_:
            self.segments.let_go(np.inf, self.ended)
        out = [(name, length, since, until, self.speakers[int(who)]) for name, _, length, since, until, who in self.ended if who >= 0]
        self.ended.clear()
        return out


def label_by_overlap(segments: DataFrame, turns: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """Give each segment the speaker of the turn with the greatest overlap.

    The first turn in time wins ties; segments that overlap no turn keep their label.
    ``segments``: ``session_id, pos, start, end, speaker``; ``turns``: ``session_id, start,
    end, speaker``.

    Intervals are dealt to the time buckets that they touch. In a bucket both sides pass in order of their starts; a task holds
    the open ones, and a segment leaves it with its best turn, so no pair is ever listed.
    """
    start = F.coalesce("start", F.lit(0.0))
    timed = segments.select(
        "session_id",
        "pos",
        start.alias("start"),
        F.coalesce(F.nullif(F.col("end"), F.lit(0.0)), start).alias("end"),
    ).filter(F.col("end") > F.col("start"))
    said = turns.filter(F.col("session_id").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    left = timed.filter(F.col("session_id").isNotNull()).select("session_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "pos", F.lit(None).cast(turns.schema["speaker"].dataType).alias("speaker"), F.lit(True).alias("segment"))
    right = said.select("session_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(None).cast(segments.schema["pos"].dataType).alias("pos"), "speaker", F.lit(False).alias("segment"))
    both = in_buckets(left, bucket_s).unionByName(in_buckets(right, bucket_s)).select("session_id", "bucket", "start", "end", "pos", "speaker", "segment")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, _Sweep()
        for batch in batches:
            found: list[tuple] = []
            for session, bucket, since, until, position, speaker, is_segment in zip(*(c.to_pylist() for c in batch.columns)):
                if (session, bucket) != key:
                    found += [(key[0], *row) for row in now.take(True)] if key else []
                    key, now = (session, bucket), _Sweep()
                if is_segment:
                    now.segment(since, until, position)
                else:
                    now.turn(since, until, speaker)
            found += [(key[0], *row) for row in now.take(False)]
            yield _batch(found, batch)
        if key:
            yield _batch([(key[0], *row) for row in now.take(True)], batch)

    def _batch(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [like.schema.field("session_id").type, like.schema.field("pos").type, *[pa.float64()] * 3, like.schema.field("speaker").type]
        columns = zip(*rows) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["session_id", "pos", "length", "t0", "t1", "matched"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = f"session_id {kinds['session_id']}, pos {kinds['pos']}, length double, t0 double, t1 double, matched {kinds['speaker']}"
    dealt = both.repartition(parallelism(segments), "session_id", "bucket").sortWithinPartitions("session_id", "bucket", "start", "end")
    best = dealt.mapInArrow(sweep, schema).groupBy("session_id", "pos").agg(F.max_by("matched", F.struct("length", -F.col("t0"), -F.col("t1"))).alias("matched"))
    return segments.join(best, ["session_id", "pos"], "left").withColumn(
        "speaker", F.coalesce("matched", "speaker")
    ).drop("matched")


def intersection_seconds(
    left: DataFrame, right: DataFrame, keys: Sequence[str], bucket_s: float = 3600.0
) -> DataFrame:
    """Seconds that the intervals of both sides share, per key (keys without any are absent).

    Between two neighbouring edges every pair of open intervals of the two sides shares that time: the sum is the product of how
    many are open, which running sums over the edges give. Work follows the number of intervals, not of pairs.
    """
    keys = list(keys)

    def edges(df: DataFrame, ours: int, others: int) -> DataFrame:
        rows = df.filter(F.col("end") > F.col("start"))
        edge = lambda name, sign: F.struct(F.col(name).cast("double").alias("point"), F.lit(sign * ours).alias("a"), F.lit(sign * others).alias("b"))
        return rows.select(*keys, F.inline(F.array(edge("start", 1), edge("end", -1))))

    changes = edges(left, 1, 0).unionByName(edges(right, 0, 1))
    points = settle(changes.groupBy(*keys, "point").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "edges")
    scans = {
        "since": Scan("last", F.col("point"), inclusive=False),
        "open_a": Scan("sum", F.col("a"), inclusive=False),
        "open_b": Scan("sum", F.col("b"), inclusive=False),
    }
    cells = prefix_scan(points, keys, time_chunk("point", bucket_s), ["point"], scans)
    shared = cells.filter((F.col("open_a") > 0) & (F.col("open_b") > 0))
    return shared.groupBy(*keys).agg(F.sum((F.col("point") - F.col("since")) * F.col("open_a") * F.col("open_b")).alias("shared_s"))
