"""Linking over a stream in several micro-batches with late rows, against the batch form."""

import random

import numpy as np
from pyspark.sql import functions as F

from parlance.plans import speakers as sp
from parlance.streaming import live, voices

KINDS = "user_id int, ts timestamp, cluster_id long, label string, embedding array<float>"


def arrivals(spark, folder, batches):
    """A file per batch, so that each is a micro-batch of its own."""
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "user_id int, s long, cluster_id long, label string, embedding array<float>")
        frame.select("user_id", F.timestamp_seconds("s").alias("ts"), "cluster_id", "label", "embedding").coalesce(1).write.mode("append").parquet(f"{folder}/b{n:02d}")
    return spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    rng, seeds = random.Random(4), np.random.default_rng(4).normal(size=(6, 8))
    rows = []
    for n in range(120):
        noise = np.random.default_rng(n).normal(size=8) * 0.35
        vector = [0.0] * 8 if n % 37 == 5 else [float(x) for x in seeds[rng.randrange(6)] + noise]
        rows.append((n % 3, 1000 + 10 * n, n, rng.choice(["USER", "SPEAKER_1"]), vector))
    cut = [rows[i : i + 30] for i in range(0, 120, 30)]
    late = [cut[1].pop(k) for k in (3, 11, 20)]
    cut[2] += late  # within the delay of 400 seconds
    lost = (0, 1, 500, "SPEAKER_1", rows[0][4])  # far behind the watermark when it comes
    cut[3].append(lost)
    for part in cut:
        rng.shuffle(part)
    with voices.keyed_state(spark):
        links = live.drained(voices.live_links(arrivals(spark, str(tmp_path / "in"), cut), 0.6, "400 seconds"), "links")
    got = {r.cluster_id: r for r in links.collect()}
    seen = 1000 + 10 * 119 - 400  # the last watermark
    batch = spark.createDataFrame(rows, "user_id int, ord long, cluster_id long, label string, embedding array<float>")
    want = {r.cluster_id: r for r in sp.link_ordered(batch, 0.6).collect() if 1000 + 10 * r.cluster_id < seen}
    assert got.keys() == want.keys() and len(want) > 60 and 500 not in got
    for key, row in want.items():
        assert (got[key].speaker_id, got[key].is_new, got[key].mention_count, got[key].is_user) == (row.speaker_id, row.is_new, row.mention_count, row.is_user)
        assert np.allclose(got[key].centroid, row.centroid)
    assert len({r.speaker_id for r in want.values()}) < len(want)


def test_forgotten_voices(spark, tmp_path):
    vector = [1.0, 2.0, 3.0]
    times = [1000, 1050, 1090, 1500, 1520, 6000]
    stream = arrivals(spark, str(tmp_path / "in"), [[(1, s, n, "SPEAKER_1", vector)] for n, s in enumerate(times)])
    with voices.keyed_state(spark):
        links = live.drained(voices.live_links(stream, 0.6, "0 seconds", forget_after_s=100), "links")
    found = {r.cluster_id: r.speaker_id for r in links.collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
