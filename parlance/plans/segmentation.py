"""Voice activity to conversations: frames, silences, conversations, child sessions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.intervals import HOUR, time_chunk
from parlance.operators.scans import Scan, interval_islands, island_ids, prefix_scan
from parlance.session import parallelism, settle

FRAME_SECONDS = 512 / 16000
FRAME_CHUNK = 65536
EDGE_SLACK_S = 0.05


def frame_index(seconds: Column, frame_s: float = FRAME_SECONDS) -> Column:
    """The fixed frame that a point in time falls into."""
    return F.floor(seconds / F.lit(frame_s)).cast("long")


def _checked(threshold: float, neg_threshold: float | None) -> tuple[float, float]:
    if neg_threshold is None:
        neg_threshold = max(threshold - 0.15, 0.01)
    if neg_threshold > threshold:
        raise ValueError("neg_threshold must not exceed threshold")
    return threshold, neg_threshold


class _ChunkFold:
    """Folds the frames of whole chunks: hysteresis, then bridging, for several settings at once.

    What a chunk's frames before its first decisive one are depends on the state before the chunk: their runs are its head and
    count only if that state is speech. All other runs are its body. A run inside head or body is whole; the first and the
    last of each may go on in the next one.
    """

    def __init__(self, settings: Sequence[tuple[float, float, float]], frame_s: float):
        self.settings, self.frame_s = settings, frame_s

    def fold(self, number: np.ndarray, prob: np.ndarray, group: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        """Columns of runs (and of a row per chunk with the state behind it) from frames, sorted by their dense group number."""
        count = len(number)
        at = np.arange(count)
        first = np.searchsorted(group, np.arange(int(group[-1]) + 1))
        states: dict[tuple[float, float], tuple] = {}
        for n, (threshold, neg_threshold, bridge_s) in enumerate(self.settings):
            if (threshold, neg_threshold) not in states:
                decisive = np.where(prob >= threshold, 1, np.where(prob < neg_threshold, 0, -1))
                last = np.maximum.accumulate(np.where(decisive >= 0, at, -1))
                head = last < first[group]
                picked = np.flatnonzero(head | (decisive[np.maximum(last, 0)] == 1))
                opens = np.ones(len(picked), dtype=bool)
                before, now = picked[:-1], picked[1:]
                opens[1:] = (group[now] != group[before]) | (head[now] != head[before]) | (number[now] - number[before] > 1)
                starts = np.flatnonzero(opens)
                ends = np.append(starts[1:], len(picked))[: len(starts)] - 1
                final = np.append(first[1:], count) - 1
                exits = np.where(head[final], -1, decisive[np.maximum(last[final], 0)])
                states[threshold, neg_threshold] = (group[picked[starts]], head[picked[starts]], number[picked[starts]], number[picked[ends]] + 1, exits)
            own, is_head, low, high, exits = states[threshold, neg_threshold]
            if len(own):
                opens = np.ones(len(own), dtype=bool)
                gap = low[1:] * self.frame_s - high[:-1] * self.frame_s
                opens[1:] = (own[1:] != own[:-1]) | (is_head[1:] != is_head[:-1]) | (gap >= max(bridge_s, self.frame_s / 2))
                starts = np.flatnonzero(opens)
                ends = np.append(starts[1:], len(own)) - 1
                own, is_head, low, high = own[starts], is_head[starts], low[starts], high[ends]
                seam = np.append(True, (own[1:] != own[:-1]) | (is_head[1:] != is_head[:-1]))
                border = seam | np.append(seam[1:], True)
                yield {"group": own, "setting": np.full(len(own), n), "part": np.where(is_head, 0, 1), "low": low, "high": high, "border": border}
            rows = len(exits)
            yield {"group": np.arange(rows), "setting": np.full(rows, n), "part": np.full(rows, 2), "low": exits, "high": exits, "border": np.zeros(rows, dtype=bool)}


def folded_frames(
    frames: DataFrame, settings: Sequence[tuple[float, float, float]], frame_s: float = FRAME_SECONDS, chunk_frames: int = FRAME_CHUNK
) -> DataFrame:
    """Runs of speech of each chunk of frames, under each setting ``(threshold, neg_threshold, bridge_s)``; one pass over the frames.

    ``setting, session_id, chunk, part, low, high, border``: part 0 and 1 are runs of the chunk's head and body (frame numbers, the
    end exclusive), part 2 holds the state behind the chunk in ``low`` (-1: as before it).
    """
    fold = _ChunkFold(list(settings), frame_s)
    rows = frames.select("session_id", F.floor(F.col("frame_idx") / chunk_frames).cast("long").alias("chunk"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("prob").cast("double").alias("prob"))
    dealt = rows.repartition(parallelism(frames), "session_id", "chunk").sortWithinPartitions("session_id", "chunk", "frame_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            number, prob = table.column("frame_idx").to_numpy(), table.column("prob").to_numpy()
            first = pa.array(np.searchsorted(group, np.arange(int(group[-1]) + 1)))
            names = table.select(["session_id", "chunk"]).take(first)
            for columns in fold.fold(number, np.where(np.isnan(prob), -1.0, prob), group):
                own = names.take(pa.array(columns["group"]))
                out = pa.table({
                    "setting": pa.array(columns["setting"], pa.int32()), "session_id": own.column("session_id"), "chunk": own.column("chunk"), "part": pa.array(columns["part"], pa.int32()),
                    "low": pa.array(columns["low"], pa.int64()), "high": pa.array(columns["high"], pa.int64()), "border": pa.array(columns["border"]),
                })
                yield from out.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            group = _group_numbers(table)
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last chunk may go on
            if whole:
                yield from done(table.slice(0, whole), group[:whole])
            held = table.slice(whole).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from done(table, _group_numbers(table))

    kind = dict(rows.dtypes)["session_id"]
    return dealt.mapInArrow(run, f"setting int, session_id {kind}, chunk long, part int, low long, high long, border boolean")


def _group_numbers(table: pa.Table) -> np.ndarray:
    """Numbers of the runs of equal (session, chunk)."""
    if not table.num_rows:
        return np.zeros(0, dtype=np.int64)
    sessions = table.column("session_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    chunks = table.column("chunk").to_numpy()
    changed = (sessions[1:] != sessions[:-1]) | (chunks[1:] != chunks[:-1])
    return np.concatenate([[0], np.cumsum(changed)]).astype(np.int64)


def _joined_runs(folded: DataFrame, bridges: Sequence[float], frame_s: float) -> DataFrame:
    """``setting, session_id, start, end``: runs joined across chunks, where their gap is below the setting's.

    Only states and border runs, a few rows per chunk, meet per session; all other runs are whole.
    """
    keys = ["setting", "session_id"]
    states = folded.filter("part = 2").select(*keys, "chunk", F.when(F.col("low") >= 0, F.col("low")).alias("state"))
    entry = F.last("state", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    spoken = states.withColumn("entry", entry).filter("entry = 1").select(*keys, "chunk")
    runs = folded.filter("part < 2").select(*keys, "chunk", "part", "border", (F.col("low") * F.lit(frame_s)).alias("start"), (F.col("high") * F.lit(frame_s)).alias("end"))
    runs = runs.filter("part = 1").unionByName(runs.filter("part = 0").join(spoken, [*keys, "chunk"], "left_semi"))
    order = Window.partitionBy(*keys).orderBy("chunk", "part", "start")
    bridge = F.element_at(F.array(*(F.lit(float(max(x, frame_s / 2))) for x in bridges)), F.col("setting") + 1)
    apart = (F.col("start") - F.lag("end").over(order) >= bridge) | ((F.lag("chunk").over(order) == F.col("chunk")) & (F.lag("part").over(order) == F.col("part")))
    borders = runs.filter("border").withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = borders.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    return joined.unionByName(runs.filter("not border").select(*keys, "start", "end"))


def speech_regions(
    frames: DataFrame,
    frame_s: float = FRAME_SECONDS,
    threshold: float = 0.5,
    neg_threshold: float | None = None,
    chunk_frames: int = FRAME_CHUNK,
) -> DataFrame:
    """Hysteresis: speech starts at ``prob >= threshold`` and ends at ``prob < neg_threshold``.

    ``frames`` holds ``session_id, frame_idx, prob``.  The state of a frame is the last
    decisive frame up to it.
    """
    folded = settle(folded_frames(frames, [(*_checked(threshold, neg_threshold), 0.0)], frame_s, chunk_frames), "runs")
    return _joined_runs(folded, [0.0], frame_s).drop("setting")


def bridged_speech(
    regions: DataFrame,
    durations: DataFrame,
    min_speech_s: float = 0.3,
    min_silence_s: float = 0.5,
    chunk_s: float = HOUR,
) -> DataFrame:
    """Join regions closer than ``min_silence_s``; then drop those under ``min_speech_s``."""
    joined = interval_islands(
        regions.select("session_id", "start", "end"),
        ["session_id"],
        time_chunk("start", chunk_s),
        "start",
        "end",
        lambda gap: gap >= min_silence_s,
    )
    merged = joined.groupBy("session_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return (
        merged.join(durations.select("session_id", "duration_s"), "session_id")
        .withColumn("end", F.least("end", "duration_s"))
        .filter(F.col("end") - F.col("start") >= min_speech_s)
        .select("session_id", "start", "end")
    )


def _value(given: float | Column) -> Column:
    return given if isinstance(given, Column) else F.lit(given)


def silences_between(
    speech: DataFrame, durations: DataFrame, min_silence_s: float | Column = 0.5, chunk_s: float = HOUR, keys: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Complement of speech: gaps between regions, long edges, the whole span if no speech.

    ``keys`` name a session; with more of them, and settings among them, several settings are handled at once.
    """
    keys = list(keys)
    gaps = prefix_scan(
        speech.select(*keys, "start", "end"),
        keys,
        time_chunk("start", chunk_s),
        ["start", "end"],
        {"silence_start": Scan("last", F.col("end"), inclusive=False)},
    )
    inner = gaps.filter(F.col("silence_start").isNotNull()).select(
        *keys, F.col("silence_start").alias("start"), F.col("start").alias("end")
    )
    bounds = speech.groupBy(*keys).agg(
        F.min("start").alias("first_start"), F.max_by("end", F.struct("start", "end")).alias("last_end")
    )
    spans = durations.filter(F.col("duration_s") > 0).select(*keys, "duration_s").join(
        bounds, keys, "left"
    )
    zero = F.lit(0.0)
    lead = F.when(
        F.coalesce(F.col("first_start") >= min_silence_s, F.lit(False)),
        F.struct(zero.alias("start"), F.col("first_start").alias("end")),
    )
    tail = F.when(
        F.coalesce(F.col("duration_s") - F.col("last_end") >= min_silence_s, F.lit(False)),
        F.struct(F.col("last_end").alias("start"), F.col("duration_s").alias("end")),
    )
    whole = F.when(
        F.col("first_start").isNull(), F.struct(zero.alias("start"), F.col("duration_s").alias("end"))
    )
    edges = spans.select(*keys, F.explode(F.array(lead, tail, whole)).alias("edge")).filter(
        F.col("edge").isNotNull()
    )
    return inner.unionByName(edges.select(*keys, "edge.start", "edge.end"))


def silences_from_frames(
    frames: DataFrame,
    durations: DataFrame,
    frame_s: float = FRAME_SECONDS,
    threshold: float = 0.5,
    neg_threshold: float | None = None,
    min_speech_s: float = 0.3,
    min_silence_s: float = 0.5,
) -> DataFrame:
    """Frames to silences of at least ``min_silence_s`` over each session's duration; one stored step, a few rows per chunk."""
    folded = settle(folded_frames(frames, [(*_checked(threshold, neg_threshold), min_silence_s)], frame_s), "runs")
    joined = _joined_runs(folded, [min_silence_s], frame_s).drop("setting")
    return silences_between(_kept_speech(joined, durations, min_speech_s), durations, min_silence_s)


def _kept_speech(joined: DataFrame, durations: DataFrame, min_speech_s: float | Column, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Joined regions, cut at the session's end; those under ``min_speech_s`` go."""
    lasting = joined.join(durations.select(*keys, "duration_s"), list(keys)).withColumn("end", F.least("end", "duration_s"))
    return lasting.filter(F.col("end") - F.col("start") >= _value(min_speech_s)).select(*keys, "start", "end")


def conversations_from_silences(
    sessions: DataFrame,
    silences: DataFrame,
    gap_threshold_s: float | Column = 60.0,
    pad_s: float | Column = 0.0,
    chunk_s: float = HOUR,
    keys: Sequence[str] = ("session_id",),
) -> DataFrame:
    """Cut each session at silences of at least the gap.

    ``sessions`` holds ``session_id, duration_s``.  Edge silences are trimmed only if they
    touch the edge within 0.05 s and are themselves at least a gap long.  Returns
    ``session_id, idx, start, end``; a wholly silent session has no row.
    """
    keys, gap_threshold_s, pad_s = list(keys), _value(gap_threshold_s), _value(pad_s)
    silences = settle(silences, "silences")
    long_enough = F.col("end") - F.col("start") >= gap_threshold_s
    edges = silences.groupBy(*keys).agg(
        F.min(F.struct("start", "end")).alias("head"), F.max(F.struct("start", "end")).alias("tail")
    )
    head_len = F.col("head.end") - F.col("head.start")
    tail_len = F.col("tail.end") - F.col("tail.start")
    spans = (
        sessions.filter(F.col("duration_s") > 0)
        .select(*keys, "duration_s")
        .join(edges, keys, "left")
        .select(
            *keys,
            "duration_s",
            F.when((F.col("head.start") <= EDGE_SLACK_S) & (head_len >= gap_threshold_s), F.col("head.end"))
            .otherwise(F.lit(0.0))
            .alias("speech_start"),
            F.when(
                (F.col("tail.end") >= F.col("duration_s") - EDGE_SLACK_S) & (tail_len >= gap_threshold_s),
                F.col("tail.start"),
            )
            .otherwise(F.col("duration_s"))
            .alias("speech_end"),
        )
        .filter(F.col("speech_end") > F.col("speech_start"))
    )
    splits = (
        silences.filter(long_enough)
        .select(*keys, "start", "end")
        .join(spans, keys)
        .filter((F.col("start") > F.col("speech_start")) & (F.col("end") < F.col("speech_end")))
    )
    splits = settle(splits, "splits")
    cursors = prefix_scan(
        splits,
        keys,
        time_chunk("start", chunk_s),
        ["start", "end"],
        {"cursor": Scan("last", F.col("end"), inclusive=False)},
    )
    inner = cursors.select(
        *keys,
        "duration_s",
        F.coalesce("cursor", "speech_start").alias("from_s"),
        F.col("start").alias("to_s"),
    )
    last_split = splits.groupBy(*keys).agg(F.max_by("end", F.struct("start", "end")).alias("cursor"))
    rest = spans.join(last_split, keys, "left").select(
        *keys, "duration_s", F.coalesce("cursor", "speech_start").alias("from_s"), F.col("speech_end").alias("to_s")
    )
    found = inner.unionByName(rest).filter(F.col("to_s") > F.col("from_s"))
    numbered = prefix_scan(
        found, keys, time_chunk("from_s", chunk_s), ["from_s"], {"nth": Scan("sum", F.lit(1))}
    )
    return numbered.select(
        *keys,
        (F.col("nth") - 1).cast("long").alias("idx"),
        F.greatest(F.lit(0.0), F.col("from_s") - pad_s).alias("start"),
        F.least(F.col("duration_s"), F.col("to_s") + pad_s).alias("end"),
    )


def child_sessions(sessions: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children of each capture, and the captures with their new status.

    A capture without any conversation becomes ``silent``, the others ``segmented``.
    """
    parents = sessions.select(
        F.col("id").alias("session_id"), "user_id", F.col("started_at").alias("parent_start")
    )
    shift = lambda seconds: F.timestamp_micros(
        F.unix_micros("parent_start") + F.round(seconds * 1e6).cast("long")
    )
    children = conversations.join(parents, "session_id").select(
        F.concat_ws("-", "session_id", F.col("idx").cast("string")).alias("id"),
        "user_id",
        F.col("session_id").alias("parent_id"),
        shift(F.col("start")).alias("started_at"),
        shift(F.col("end")).alias("ended_at"),
        (F.col("end") - F.col("start")).alias("duration_s"),
        F.lit("opus").alias("codec"),
        F.lit(16000).alias("sample_rate_hz"),
        F.lit("pending_stt").alias("status"),
    )
    segmented = conversations.select(F.col("session_id").alias("id")).distinct().withColumn("found", F.lit(True))
    updated = sessions.join(segmented, "id", "left").withColumns(
        {
            "status": F.when(F.col("found"), "segmented").otherwise("silent"),
            "error_msg": F.lit(None).cast("string"),
        }
    )
    return children, updated.drop("found")


def activity_conversations(
    activity: DataFrame, gap_s: float, chunk_s: float = 24 * HOUR
) -> DataFrame:
    """Conversations of a capture stream: a new one starts after a silence of the gap.

    ``activity`` holds ``user_id, event_id, t``.
    """
    rows = island_ids(
        activity.select("user_id", "event_id", "t"),
        ["user_id"],
        time_chunk("t", chunk_s),
        ["t", "event_id"],
        ["t"],
        lambda prev, cur: cur["t"] - prev["t"] >= gap_s,
        name="idx",
    )
    return rows.groupBy("user_id", "idx").agg(
        F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("n_events")
    )


def parameter_sweep(
    frames: DataFrame, durations: DataFrame, settings: list[dict[str, float]], frame_s: float = FRAME_SECONDS
) -> DataFrame:
    """Speech kept under several settings: ``setting, session_id, n_conversations, speech_s, speech_pct``.

    Each setting holds ``threshold, min_speech_s, min_silence_s, gap_s, pad_s``; thresholds and
    speech lengths are held within the ranges that the settings allow.  The frames are read once, settings that share a
    threshold share its hysteresis pass, and from there on settings are rows: the plan does not grow with their number.
    """
    held = [(min(max(x["threshold"], 0.05), 0.95), min(max(x["min_speech_s"], 0.0), 5.0), float(x["min_silence_s"]), float(x["gap_s"]), float(x["pad_s"])) for x in settings]
    bridges = [x[2] for x in held]
    folded = settle(folded_frames(frames, [(*_checked(x[0], None), x[2]) for x in held], frame_s), "runs")
    names = ("min_speech_s", "min_silence_s", "gap_s", "pad_s")
    rows = F.array(*(F.struct(F.lit(n).alias("setting"), *(F.lit(float(v)).alias(k) for k, v in zip(names, x[1:]))) for n, x in enumerate(held)))
    spans = settle(durations.select("session_id", F.col("duration_s").cast("double").alias("duration_s"), F.inline(rows)), "spans")
    keys = ["setting", "session_id", *names]  # a setting's values go along as keys
    joined = _joined_runs(folded, bridges, frame_s).join(spans.drop("duration_s"), ["setting", "session_id"])
    speech = _kept_speech(joined, spans, F.col("min_speech_s"), keys)
    silences = silences_between(speech, spans, F.col("min_silence_s"), keys=keys)
    kept = conversations_from_silences(spans, silences, F.col("gap_s"), F.col("pad_s"), keys=keys)
    total = kept.groupBy("setting", "session_id").agg(
        F.count("*").alias("n_conversations"), F.sum(F.col("end") - F.col("start")).alias("speech_s")
    )
    speech_s = F.coalesce("speech_s", F.lit(0.0))
    return spans.join(total, ["setting", "session_id"], "left").select(
        "setting",
        "session_id",
        F.coalesce("n_conversations", F.lit(0)).alias("n_conversations"),
        speech_s.alias("speech_s"),
        F.when(F.col("duration_s") > 0, speech_s / F.col("duration_s") * 100).otherwise(F.lit(0.0)).alias("speech_pct"),
    )
