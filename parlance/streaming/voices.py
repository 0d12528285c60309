"""Speakers linked in order over a stream of clusters: state per user, event-time order, late rows within the delay."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.plans.speakers import LINK_THRESHOLD, Registry

#: The state store that keyed state needs, and the setting that names it; set it before the stream is started.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LINKED = "user_id {user}, cluster_id {cluster}, speaker_id {cluster}, is_new boolean, mention_count int, is_user boolean, centroid array<double>"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside the block use ``STATE_STORE``; the session's own setting comes back after it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class VoiceLinker(StatefulProcessor):
    """Voices of each user as map state; clusters wait in list state until the watermark has passed them.

    A waiting cluster sets a timer one millisecond after its time. When it fires, no earlier cluster can arrive any more, and all
    clusters before the watermark are linked in order of (time, id), as the batch form does. Only the voices that a call has changed
    are written back. With ``forget_after_s`` a voice that was not heard for so long is forgotten.
    """

    def __init__(self, threshold: float, cluster: str, forget_after_s: float | None = None):
        self.threshold, self.cluster, self.forget_after_s = threshold, cluster, forget_after_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        voice = "rank int, mention_count int, is_user boolean, centroid array<double>, heard_us bigint"
        self.voices = handle.getMapState("voices", f"speaker_id {self.cluster}", voice)
        self.waiting = handle.getListState("waiting", f"us bigint, cluster_id {self.cluster}, label string, embedding array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            for row in frame.itertuples(index=False):
                vector = [] if row.embedding is None else [float(x) for x in row.embedding]
                new.append((int(row.us), row.cluster_id, row.label, vector))
        if new:
            self.waiting.appendList(new)
            for due in {us // 1000 + 1 for us, *_ in new}:
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] // 1000 < upto), key=lambda r: (r[0], r[1]))
        if not ready:
            return
        left = [tuple(r) for r in held if r[0] // 1000 >= upto]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        stored = sorted(((name[0], *voice) for name, voice in self.voices.iterator()), key=lambda v: v[1])
        registry, heard, before, changed = Registry([]), {}, {}, set()
        for name, rank, count, wearer, centroid, us in stored:
            registry.know(name, count, wearer, centroid)
            heard[name], before[name] = us, rank
        rank = max(before.values(), default=-1)
        out = []
        for us, cluster_id, label, embedding in ready:
            if self.forget_after_s is not None:
                for name in [n for n in registry.ids if us - heard[n] > self.forget_after_s * 1e6]:
                    registry.forget(name)
                    self.voices.removeKey((name,))
                    changed.discard(name)
            vector = np.asarray(embedding, dtype="float64")
            if not vector.any():
                continue
            linked = registry.add(cluster_id, label, vector, self.threshold)
            out.append((key[0], cluster_id, *linked))
            heard[linked[0]] = us
            changed.add(linked[0])
            if linked[0] not in before or linked[1]:
                rank += 1
                before[linked[0]] = rank
        for at, name in enumerate(registry.ids):
            if name in changed:
                self.voices.updateValue((name,), (before[name], registry.counts[at], registry.wearer[at], registry.centroids[at].tolist(), heard[name]))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "cluster_id", "speaker_id", "is_new", "mention_count", "is_user", "centroid"])

    def close(self) -> None:
        pass


def live_links(clusters: DataFrame, threshold: float = LINK_THRESHOLD, delay: str = "10 minutes", forget_after_s: float | None = None) -> DataFrame:
    """Stream form of ``speakers.link_ordered``: ``user_id, ts, cluster_id, label, embedding`` in, a row per linked cluster out.

    A cluster comes out once the watermark, ``delay`` behind the newest time, has passed it; rows that arrive behind the watermark are
    dropped. State per user: its voices, and its clusters of the last ``delay``. Start it inside ``keyed_state``.
    """
    names = dict(clusters.select("user_id", "cluster_id").dtypes)
    rows = clusters.select("user_id", "ts", F.unix_micros("ts").alias("us"), "cluster_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(
        VoiceLinker(threshold, names["cluster_id"], forget_after_s), LINKED.format(user=names["user_id"], cluster=names["cluster_id"]), "append", "EventTime"
    )
