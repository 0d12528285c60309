"""The speaker registry: linking clusters to known voices, merging and editing speakers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from parlance.functions.text import string_or_null
from parlance.functions.vectors import is_zero
from parlance.operators.overlap import label_by_overlap
from parlance.operators.rows import without
from parlance.operators.vectors import mean_vectors, nearest, similarity_components
from parlance.plans.transcripts import PREVIEW_SECONDS, WEARER, relabel_by_talk_time
from parlance.session import parallelism, settle

LINK_THRESHOLD = 0.6


def merge_clusters(turns: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """Rename turn speakers to the smallest label of their similarity component.

    ``clusters``: ``session_id, label, embedding``.  A threshold of 1 or more turns it off;
    labels without an embedding stay.
    """
    if threshold >= 1.0:
        return turns
    parts = similarity_components(clusters, "session_id", "label", threshold=threshold)
    names = parts.select("session_id", F.col("label").alias("speaker"), "survivor")
    return (
        turns.join(names, ["session_id", "speaker"], "left")
        .withColumn("speaker", F.coalesce("survivor", "speaker"))
        .select(*turns.columns)
    )


def labelled_segments(
    segments: DataFrame,
    turns: DataFrame,
    clusters: DataFrame,
    merge_threshold: float = 1.0,
    failed: DataFrame | None = None,
    bucket_s: float = 60.0,
) -> DataFrame:
    """Segments with the labels of a labelling run: alike clusters merged, labels by overlap, then by talk time.

    ``segments``: ``session_id, pos, start, end, speaker``; ``turns``: the run's ``session_id, start, end, speaker``;
    ``clusters``: see ``merge_clusters``. Sessions of ``failed`` (``session_id``) keep their segments as they are, since
    labels only improve a transcript; so do segments without a session, which no turn can meet.
    """
    gone = None if failed is None else failed.select("session_id").distinct()
    usable = F.col("session_id").isNotNull()
    tried = segments.filter(usable)
    kept = segments.filter(~usable)
    if gone is not None:
        kept = kept.unionByName(tried.join(gone, "session_id", "left_semi"))
        tried = tried.join(gone, "session_id", "left_anti")
    merged = merge_clusters(turns, clusters, merge_threshold)
    labelled = settle(label_by_overlap(tried, merged, bucket_s), "labelled")
    return relabel_by_talk_time(labelled).select(*segments.columns).unionByName(kept.select(*segments.columns))


def cluster_embeddings(clips: DataFrame) -> DataFrame:
    """One mean embedding per session and label, from embedded clips."""
    return mean_vectors(clips, ["session_id", "speaker"], "embedding")


def link_frozen(clusters: DataFrame, speakers: DataFrame, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """Link every cluster against the centroids as they stand; fully parallel.

    ``clusters``: ``user_id, cluster_id, embedding``.  Clusters without a match, except zero vectors, are grouped by
    similarity; each group founds a speaker (``is_new``) whose id can't meet a known one: ``minted_id`` of the
    group's smallest cluster.
    """
    usable = clusters.filter(~is_zero(F.col("embedding")))
    found = nearest(usable, speakers.withColumnRenamed("id", "speaker_id"), "user_id", "cluster_id", "speaker_id",
                    threshold=threshold)
    founders = similarity_components(
        usable.join(found, ["user_id", "cluster_id"], "left_anti"), "user_id", "cluster_id", threshold=threshold
    ).select("user_id", "cluster_id", minted_id(F.col("survivor"), usable.schema["cluster_id"].dataType).alias("new_id"))
    linked = found.select("user_id", "cluster_id", "speaker_id", F.lit(False).alias("is_new"), "similarity")
    new = founders.select("user_id", "cluster_id", F.col("new_id").alias("speaker_id"), F.lit(True).alias("is_new"), F.lit(None).cast("double").alias("similarity"))
    return linked.unionByName(new)


def minted_id(cluster_id: Column, kind: DataType) -> Column:
    """The id of a speaker that a cluster founds: ``new-…`` for texts, below zero for numbers (known ids are not)."""
    return F.concat(F.lit("new-"), cluster_id) if isinstance(kind, StringType) else -cluster_id - F.lit(1)


def updated_centroids(links: DataFrame, clusters: DataFrame, speakers: DataFrame) -> DataFrame:
    """Speakers after a frozen linking round: the mean weighted by mention count, and the count."""
    old = speakers.select(
        "user_id", F.col("id").alias("speaker_id"), "embedding", F.col("mention_count").cast("double").alias("weight")
    )
    new = links.join(clusters, ["user_id", "cluster_id"]).select(
        "user_id", "speaker_id", "embedding", F.lit(1.0).alias("weight")
    )
    both = old.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(
        new.withColumn("embedding", F.col("embedding").cast("array<double>"))
    )
    counts = both.groupBy("user_id", "speaker_id").agg(F.sum("weight").cast("long").alias("mention_count"))
    means = mean_vectors(both, ["user_id", "speaker_id"], "embedding", F.col("weight"))
    return means.join(counts, ["user_id", "speaker_id"])


class Registry:
    """Known voices of one user while clusters are folded in order."""

    def __init__(self, known: list[dict]):
        self.ids, self.counts, self.wearer, self.centroids = [], [], [], []
        for k in known:
            self.know(k["id"], k["mention_count"], k["is_user"], k["embedding"])

    def know(self, speaker_id, mention_count: int, is_user: bool, embedding) -> None:
        """A voice that is known from the start."""
        self.ids.append(speaker_id)
        self.counts.append(int(mention_count))
        self.wearer.append(bool(is_user))
        self.centroids.append(np.asarray(embedding, dtype="float64"))

    def forget(self, speaker_id) -> None:
        at = self.ids.index(speaker_id)
        for column in (self.ids, self.counts, self.wearer, self.centroids):
            del column[at]

    def add(self, cluster_id, label: str, vector: np.ndarray, threshold: float) -> tuple:
        """Link one cluster; returns ``(speaker_id, is_new, mention_count, is_user, centroid)``."""
        best, score = None, threshold
        size = np.linalg.norm(vector)
        for i, centroid in enumerate(self.centroids):
            scale = size * np.linalg.norm(centroid)
            if len(centroid) == len(vector) and scale > 0:
                similarity = float(vector @ centroid) / scale
                if similarity > score:
                    best, score = i, similarity
        fresh = best is None
        if fresh:
            best = len(self.ids)
            self.ids.append(cluster_id)
            self.counts.append(0)
            self.wearer.append(False)
            self.centroids.append(np.zeros_like(vector))
        n = self.counts[best]
        # Fractions of the running mean are kept in float32, as they are stored.
        self.centroids[best] = ((self.centroids[best] * n + vector) / (n + 1)).astype("float32").astype("float64")
        self.counts[best] = n + 1
        self.wearer[best] |= label == WEARER
        return self.ids[best], fresh, n + 1, self.wearer[best], self.centroids[best].tolist()


LINKED = (
    "user_id {user}, cluster_id {cluster}, speaker_id {cluster}, is_new boolean,"
    " mention_count int, is_user boolean, centroid array<double>"
)


def link_ordered(clusters: DataFrame, threshold: float = LINK_THRESHOLD, speakers: DataFrame | None = None) -> DataFrame:
    """Link clusters one after another; each link moves the centroid that later ones see.

    ``clusters``: ``user_id, ord, cluster_id, label, embedding``; ``speakers`` is the registry to start from (``user_id, id,
    embedding, mention_count, is_user``). A new speaker has its first cluster's id, or beside a registry the ``minted_id`` of
    it. The order is part of the result, so one user's clusters pass through one task; they stream through it sorted,
    and only the user's voices are held.  Use ``link_frozen`` where that is too slow.
    """
    names = clusters.select("user_id", "cluster_id").dtypes
    schema = LINKED.format(user=names[0][1], cluster=names[1][1])
    kind = clusters.schema["cluster_id"].dataType
    ids = F.col("cluster_id") if speakers is None else minted_id(F.col("cluster_id"), kind)
    rows = clusters.select(
        "user_id", F.lit(1).alias("side"), "ord", "cluster_id", ids.alias("new_id"), "label", "embedding",
        F.lit(0).cast("long").alias("mention_count"), F.lit(False).alias("is_user"),
    )
    if speakers is not None:
        first = F.lit(None).cast(clusters.schema["ord"].dataType)
        known = speakers.filter(F.col("embedding").isNotNull()).select(
            "user_id", F.lit(0).alias("side"), first.alias("ord"), F.col("id").cast(kind).alias("cluster_id"), F.col("id").cast(kind).alias("new_id"),
            F.lit(None).cast("string").alias("label"), F.col("embedding").cast(clusters.schema["embedding"].dataType).alias("embedding"),
            F.col("mention_count").cast("long").alias("mention_count"), F.coalesce("is_user", F.lit(False)).alias("is_user"),
        )
        rows = known.unionByName(rows)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, registry = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if registry is None or row.user_id != user:
                    user, registry = row.user_id, Registry([])
                if row.side == 0:
                    registry.know(row.new_id, row.mention_count, row.is_user, row.embedding)
                    continue
                vector = np.asarray(row.embedding if row.embedding is not None else [], dtype="float64")
                if vector.any():
                    out.append((user, row.cluster_id, *registry.add(row.new_id, row.label, vector, threshold)))
            yield pd.DataFrame(
                out,
                columns=["user_id", "cluster_id", "speaker_id", "is_new", "mention_count", "is_user", "centroid"],
            )

    ordered = (
        rows.repartition(parallelism(clusters), "user_id")
        .sortWithinPartitions("user_id", "side", "ord", "cluster_id")
    )
    return ordered.mapInPandas(fold, schema)


def registry_after(links: DataFrame) -> DataFrame:
    """Speakers as they stand after an ordered linking."""
    return links.groupBy("user_id", "speaker_id").agg(
        F.max("mention_count").alias("mention_count"),
        F.max("is_user").alias("is_user"),
        F.max_by("centroid", "mention_count").alias("embedding"),
    )


def with_speaker_ids(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Segments with the speaker linked to their session and label (``session_id, label, speaker_id``)."""
    ids = links.select("session_id", F.col("label").alias("speaker"), F.col("speaker_id").alias("__id"))
    columns = [c for c in segments.columns if c != "speaker_id"]
    kept = F.col("speaker_id") if "speaker_id" in segments.columns else F.lit(None).cast("string")
    return segments.join(ids, ["session_id", "speaker"], "left").select(
        *columns, F.coalesce(F.col("__id").cast("string"), kept).alias("speaker_id")
    )


def updated_previews(speakers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Speakers with the longest preview clip; a candidate must beat the stored one.

    ``candidates``: ``speaker_id, session_id, start, end, ord``; of equal lengths the first
    in ``ord`` counts.
    """
    clipped = candidates.withColumn("end", F.least(F.col("end"), F.col("start") + PREVIEW_SECONDS)).withColumn(
        "length", F.col("end") - F.col("start")
    )
    best = clipped.groupBy(F.col("speaker_id").alias("id")).agg(
        F.max_by(F.struct("session_id", "start", "end", "length"), F.struct("length", -F.col("ord"))).alias("clip")
    )
    stored = F.coalesce(F.col("preview_end_s") - F.col("preview_start_s"), F.lit(0.0))
    longer = F.coalesce(F.col("clip.length") > stored, F.lit(False))
    pick = lambda field, old: F.when(longer, F.col(f"clip.{field}")).otherwise(F.col(old))
    return speakers.join(best, "id", "left").withColumns(
        {
            "preview_audio_session_id": pick("session_id", "preview_audio_session_id"),
            "preview_start_s": pick("start", "preview_start_s"),
            "preview_end_s": pick("end", "preview_end_s"),
        }
    ).select(*speakers.columns)


def merge_ranks(speakers: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected speakers in merge order: named first, then most mentions, then oldest.

    ``selection``: ``merge_id, id`` with at least two distinct ids per merge.
    """
    chosen = speakers.join(selection.select("merge_id", "id").distinct(), "id")
    order = Window.partitionBy("merge_id").orderBy(
        string_or_null(F.col("name")).isNotNull().desc(), F.col("mention_count").desc(), F.col("created_at"), F.col("id")
    )
    return chosen.withColumn("rank", F.row_number().over(order))


def missing_selection(speakers: DataFrame, selection: DataFrame) -> DataFrame:
    """Requested ids that are no speaker of the user; a merge with such an id is refused."""
    return selection.join(speakers, ["user_id", "id"], "left_anti")


def merged_speakers(speakers: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The primaries with merged values, and the mapping ``id -> primary_id`` of all merged rows."""
    ranked = merge_ranks(speakers, selection)
    weight = F.when(F.col("mention_count") > 0, F.col("mention_count").cast("double")).otherwise(F.lit(1.0))
    centroids = mean_vectors(ranked, ["merge_id"], "embedding", weight)
    named = F.when(string_or_null(F.col("name")).isNotNull(), F.col("rank"))
    flags = ranked.groupBy("merge_id").agg(
        F.min_by("id", "rank").alias("primary_id"),
        F.sum(F.greatest(F.lit(1), "mention_count")).cast("int").alias("mention_count"),
        F.bool_or("is_user").alias("is_user"),
        F.min_by("name", named).alias("name"),
    )
    primaries = flags.join(centroids, "merge_id").select(
        "merge_id", F.col("primary_id").alias("id"), "name", "mention_count", "is_user", "embedding"
    )
    mapping = ranked.select("merge_id", "id").join(flags.select("merge_id", "primary_id"), "merge_id")
    return primaries, mapping.select("id", "primary_id")


def after_merge(speakers: DataFrame, primaries: DataFrame, mapping: DataFrame) -> DataFrame:
    """The registry without the secondaries and with the merged primaries."""
    gone = mapping.filter(F.col("id") != F.col("primary_id")).select("id")
    new = primaries.select(
        "id",
        *[F.col(c).alias(f"__{c}") for c in ("name", "mention_count", "is_user")],
        F.col("embedding").cast("array<float>").alias("__embedding"),
    )
    updated = speakers.join(gone, "id", "left_anti").join(new, "id", "left")
    changes = {c: F.when(F.col("__mention_count").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c))
               for c in ("name", "mention_count", "is_user", "embedding")}
    return updated.withColumns(changes).select(*speakers.columns)


def rewritten_segments(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Long-form segments pointing at the primaries."""
    to = mapping.select(F.col("id").cast("string").alias("speaker_id"), F.col("primary_id").cast("string").alias("__to"))
    return segments.join(to, "speaker_id", "left").withColumn("speaker_id", F.coalesce("__to", "speaker_id")).select(
        *segments.columns
    )


def without_speakers(speakers: DataFrame, segments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Speakers without those listed (``id``), and the segments with their links to them cleared; the labels stay."""
    gone = ids.select(F.col("id").cast("string").alias("__gone")).distinct()
    linked = segments.join(gone, F.col("speaker_id").cast("string") == F.col("__gone"), "left")
    cleared = linked.withColumn("speaker_id", F.when(F.col("__gone").isNull(), F.col("speaker_id"))).select(*segments.columns)
    return without(speakers, ids, "id"), cleared
