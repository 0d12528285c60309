"""Capture segments of live connections: rollover by event time.

A segment's clock starts at its first packet.  It closes when the interval has passed, and
the next packet opens a new one; ``audio-stop`` ends the connection.  The clock is the
events' own time: a segment that reaches the interval is closed at exactly that moment.
``audio-start`` changes the rate, and the open segment takes it while it is still empty.

Packets: ``connection_id, ts, seq, kind, bytes, rate`` with kind ``audio-start``,
``packet`` or ``audio-stop``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators.intervals import time_chunk
from parlance.operators.scans import Scan, island_ids, prefix_scan
from parlance.session import settle

PACKET, START, STOP = "packet", "audio-start", "audio-stop"
FIELDS = ["connection_id", "started_us", "ended_us", "n_packets", "bytes", "rate", "closed_by"]
STATE = "n_packets LONG, bytes LONG, opened LONG, rate LONG, next_rate LONG"
DAY_S = 24 * 3600.0


@dataclass
class Segment:
    """The open segment of a connection."""

    n_packets: int = 0
    bytes: int = 0
    opened: int = 0
    rate: int = 0
    next_rate: int = 0

    def close(self, at: int, by: str) -> tuple:
        """The finished segment as a row; an empty one opens anew."""
        row = (self.opened if self.n_packets else at, at, self.n_packets, self.bytes, self.rate, by)
        self.n_packets = self.bytes = self.opened = 0
        self.rate = self.next_rate
        return row

    def due(self, interval_us: int) -> int | None:
        return self.opened + interval_us if interval_us > 0 and self.n_packets else None

    def feed(self, at: int, kind: str, size: int, rate, interval_us: int) -> Iterator[tuple]:
        due = self.due(interval_us)
        if due is not None and at >= due:
            yield self.close(due, "rollover")
        if kind == PACKET:
            if not self.n_packets:
                self.opened = at
            self.n_packets += 1
            self.bytes += size
        elif kind == START and rate:
            self.next_rate = rate
            if not self.n_packets:
                self.rate = rate
        elif kind == STOP:
            yield self.close(at, "stop")
            self.rate = self.next_rate = 0


def _schema(packets: DataFrame) -> str:
    key = dict(packets.dtypes)["connection_id"]
    return (
        f"connection_id {key}, started_us LONG, ended_us LONG, n_packets LONG, bytes LONG, rate LONG, closed_by STRING"
    )


def as_sessions(segments: DataFrame, vad_enabled: bool = True) -> DataFrame:
    """Session rows of closed segments: empty ones are silent, the others wait for the next stage."""
    waiting = "pending_vad" if vad_enabled else "pending_stt"
    return segments.select(
        "connection_id",
        F.timestamp_micros("started_us").alias("started_at"),
        F.timestamp_micros("ended_us").alias("ended_at"),
        ((F.col("ended_us") - F.col("started_us")) / F.lit(1e6)).alias("duration_s"),
        F.col("bytes").alias("bytes_written"),
        F.col("rate").alias("sample_rate_hz"),
        F.when(F.col("n_packets") == 0, "silent").otherwise(waiting).alias("status"),
    )


def closed_segments(packets: DataFrame, interval_s: float, as_of_us: int | None = None, chunk_intervals: int = 64) -> DataFrame:
    """Batch form: all closed segments; with ``as_of_us`` only those closed by then.

    A stop, and a pause of the interval or more, always ends a segment; connections are cut there into parts. Inside
    a part the packets that open a segment are found by ``_opening``, so that a connection that never pauses is many
    tasks of ``chunk_intervals`` intervals each. Without an interval only stops end segments.
    """
    interval_us = int(interval_s * 1e6)
    chunk = time_chunk(F.col("us") / F.lit(1e6), DAY_S)
    rows = packets.withColumn("us", F.unix_micros("ts")).select(
        "connection_id", "us", "seq", "kind", "bytes", "rate"
    )
    rate = F.when(F.col("kind") == STOP, F.lit(0).cast("long")).when(
        (F.col("kind") == START) & (F.col("rate") > 0), F.col("rate").cast("long")
    )
    rated = prefix_scan(
        rows, ["connection_id"], chunk, ["us", "seq"], {"rate_before": Scan("last", rate, inclusive=False)}
    )

    def opens(prev, cur):
        paused = cur["us"] - prev["us"] >= interval_us if interval_us > 0 else F.lit(False)
        return (prev["kind"] == STOP) | paused

    parts = island_ids(
        settle(rated, "packets"), ["connection_id"], chunk, ["us", "seq"], ["us", "kind"], opens, name="part"
    ).withColumn("rate", F.coalesce("rate_before", F.lit(0).cast("long")))
    # All packets of an instant are in one segment, so an instant is a row.
    part = ["connection_id", "part"]
    sums = [F.sum("n_packets").alias("n_packets"), F.sum("bytes").alias("bytes"), F.min_by("rate", "us").alias("rate")]
    instants = (
        parts.filter(F.col("kind") == PACKET)
        .groupBy(*part, "us")
        .agg(F.count("*").alias("n_packets"), F.sum(F.col("bytes").cast("long")).alias("bytes"), F.min_by("rate", "seq").alias("rate"))
    )
    stops = parts.filter(F.col("kind") == STOP).select(*part, F.col("us").alias("stop_us"), F.col("rate").alias("stop_rate"))
    if interval_us > 0:
        width = chunk_intervals * interval_us
        instants = instants.withColumn("chunk", _block("us", width))
        marked = _opening(settle(instants, "instants"), interval_us, width)
        opened = Scan("last", F.when(F.col("opens"), F.col("us")))
        runs = prefix_scan(settle(marked, "opening"), part, F.col("chunk"), ["us"], {"started_us": opened})
        segments = runs.groupBy(*part, "started_us").agg(*sums)
        due = F.col("started_us") + interval_us
    else:
        segments = instants.groupBy(*part).agg(F.min("us").alias("started_us"), *sums)
        due = F.lit(None).cast("long")
    segments, stops = settle(segments, "segments"), settle(stops, "stops")
    stopped = F.col("stop_us").isNotNull() & F.coalesce(F.col("stop_us") < due, F.lit(True))
    closed = segments.join(stops, part, "left").select(
        "connection_id",
        "started_us",
        F.when(stopped, F.col("stop_us")).otherwise(due).alias("ended_us"),
        "n_packets",
        "bytes",
        "rate",
        F.when(stopped, "stop").otherwise("rollover").alias("closed_by"),
    )
    # A stop that finds no packets since the last segment closes an empty one.
    last = segments.groupBy(*part).agg(F.max("started_us").alias("started_us"))
    idle = F.col("started_us").isNull() | F.coalesce(due <= F.col("stop_us"), F.lit(False))
    zero = F.lit(0).cast("long")
    empty = stops.join(last, part, "left").filter(idle).select(
        "connection_id",
        F.col("stop_us").alias("started_us"),
        F.col("stop_us").alias("ended_us"),
        zero.alias("n_packets"),
        zero.alias("bytes"),
        F.col("stop_rate").alias("rate"),
        F.lit("stop").alias("closed_by"),
    )
    found = closed.filter(F.col("ended_us").isNotNull()).unionByName(empty).select(*FIELDS)
    return found if as_of_us is None else found.filter(F.col("ended_us") <= as_of_us)


def _block(column: str, width_us: int) -> Column:
    """The number of the chunk that a time falls into, in whole numbers."""
    time = F.col(column)
    return ((time - F.pmod(time, F.lit(width_us))) / F.lit(width_us)).cast("long")


def _by_group(df: DataFrame, keys: list[str], order: str, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the rows of each group, sorted by ``order``; a task goes through its groups one after another.

    Groups are mostly a few rows: read as runs of sorted rows they cost their rows, not an Arrow stream each.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []  # rows of the last group, which the next batch may go on with
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if waiting and all(rows[k][0] == waiting[-1][k][0] == rows[k][-1] for k in keys):
                waiting.append(rows)
            elif rows.num_rows:
                rows = pa.concat_tables([*waiting, rows]).combine_chunks()
                new = np.zeros(rows.num_rows - 1, dtype=bool)
                for k in keys:
                    new |= pc.not_equal(rows[k][1:], rows[k][:-1]).to_numpy()
                starts = [0, *(np.flatnonzero(new) + 1).tolist()]
                found = [work(rows.slice(a, b - a)) for a, b in zip(starts, starts[1:])]
                if found:
                    yield from pa.concat_tables(found).combine_chunks().to_batches()
                waiting = [rows.slice(starts[-1])]
        if waiting:
            yield from work(pa.concat_tables(waiting).combine_chunks()).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(runs, schema)


def _opening(instants: DataFrame, interval_us: int, width_us: int) -> DataFrame:
    """Marks (``opens``) the instants that open a segment, by jump pointers.

    An instant that opens a segment is followed by the first one an interval later. Inside a chunk a sorted search
    finds these followers. Only instants that can be the first opening one of their chunk (those of its first interval,
    and the next) become nodes; a node points to the first opening instant of a later chunk. Doubling the pointers
    reaches all nodes on the way from a part's first instant in as many rounds as the number of chunks has digits.
    """
    part = ["connection_id", "part"]
    kinds = {f.name: f.dataType.simpleString() for f in instants.schema}
    columns = instants.columns

    def followers(times: np.ndarray) -> np.ndarray:
        return np.searchsorted(times, times + interval_us)

    def nodes(group: pa.Table) -> pa.Table:
        times = group["us"].to_numpy()
        after = followers(times)
        last = np.where(after < len(times), after, np.arange(len(times)))
        while not np.array_equal(last[last], last):
            last = last[last]
        border = group["chunk"][0].as_py() * width_us + interval_us
        first = max(1, min(len(times), int(np.searchsorted(times, border)) + 1))
        head = group.slice(0, first).select([*part, "chunk", "us"])
        return head.append_column("due", pa.array(times[last[:first]] + interval_us))

    by_chunk = [*part, "chunk"]
    schema = f"connection_id {kinds['connection_id']}, part LONG, chunk LONG, us LONG, due LONG"
    found = settle(_by_group(instants, by_chunk, "us", nodes, schema), "nodes")

    # The first node at or after each due time: a scan over nodes and due times, from the latest to the earliest.
    asked = found.select(*part, "due").distinct().select(*part, F.col("due").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("node"))
    placed = found.select(*part, F.col("us").alias("at"), F.lit(0).alias("asks"), F.col("us").alias("node"))
    backwards = asked.unionByName(placed).withColumn("back", -F.col("at"))
    met = prefix_scan(settle(backwards, "due"), part, _block("back", width_us), ["back", "asks"], {"next": Scan("last", F.col("node"))})
    answers = met.filter("asks = 1 AND next IS NOT NULL").select(*part, F.col("at").alias("due"), "next")
    pointers = [settle(found.join(answers, [*part, "due"]).select(*part, "us", "next"), "pointers")]

    chunks = found.groupBy(*part).agg(F.count_distinct("chunk").alias("n")).agg(F.max("n")).first()[0] or 1
    while 2 ** len(pointers) < chunks:
        further = pointers[-1].select(*part, F.col("us").alias("next"), F.col("next").alias("beyond"))
        doubled = pointers[-1].join(further, [*part, "next"]).select(*part, "us", F.col("beyond").alias("next"))
        pointers.append(settle(doubled, "pointers"))
    reached = found.groupBy(*part).agg(F.min("us").alias("us"))
    for step in reversed(pointers):
        reached = settle(reached.unionByName(reached.join(step, [*part, "us"]).select(*part, F.col("next").alias("us"))), "reached")

    def walk(group: pa.Table) -> pa.Table:
        entry = group["entry"][0].as_py()
        opens = np.zeros(group.num_rows, dtype=bool)
        if entry is not None:
            times = group["us"].to_numpy()
            after = followers(times)
            at = int(np.searchsorted(times, entry))
            while at < len(times):
                opens[at] = True
                at = after[at]
        return group.select(columns).append_column("opens", pa.array(opens))

    entries = reached.select(*part, _block("us", width_us).alias("chunk"), F.col("us").alias("entry"))
    entered = instants.join(entries, [*part, "chunk"], "left")
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", opens BOOLEAN"
    return _by_group(entered, by_chunk, "us", walk, schema)


def live_segments(packets: DataFrame, interval_s: float, delay: str = "5 seconds") -> DataFrame:
    """Streaming form: a stateful fold per connection with event-time timers.

    State is one open segment per connection.  Rows of one trigger are sorted per
    connection; bound a trigger with the source's rate limits.
    """
    interval_us = int(interval_s * 1e6)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment = Segment(*state.get) if state.exists else Segment()
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["us", "seq"])
            for r in rows.itertuples(index=False):
                rate = None if pd.isna(r.rate) else int(r.rate)
                out.extend((*key, *x) for x in segment.feed(r.us, r.kind, int(r.bytes), rate, interval_us))
        due = segment.due(interval_us)
        if due is not None and due <= state.getCurrentWatermarkMs() * 1000:
            out.append((*key, *segment.close(due, "rollover")))
            due = None
        if segment == Segment():  # nothing open: the connection needs no state
            state.remove()
        else:
            state.update(astuple(segment))
            if due is not None:
                state.setTimeoutTimestamp(-(-due // 1000))
        yield pd.DataFrame(out, columns=FIELDS)

    rows = packets.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    return rows.groupBy("connection_id").applyInPandasWithState(
        step, _schema(packets), STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
