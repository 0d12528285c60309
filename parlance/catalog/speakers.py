"""Queries: embeddings, similarity, linking, merging of speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog import bindings as b
from parlance.catalog.registry import query
from parlance.functions.vectors import cosine, running_mean
from parlance.operators.vectors import mean_vectors, nearest, similar_pairs, similarity_components
from parlance.plans import archive as ar
from parlance.plans import speakers as sp
from parlance.plans import transcripts as tr
from parlance.sources.tables import given

BUCKET_S = 6 * 3600.0


def flat(df, *keys, vector="embedding"):
    """Vectors in long form, one row per dimension."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).select(
        *keys, F.col("dim").cast("long").alias("dim"), b.r6("x").alias("x")
    )


@query(
    "mean_embeddings",
    b.with_cte("clusters")
    + """
SELECT user_id, voice, i - 1 AS dim, round(avg(embedding[i]), 6) AS x
FROM clusters, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i) GROUP BY ALL""",
)
def mean_embeddings(spark, d):
    return flat(mean_vectors(b.clusters(spark, d), ["user_id", "voice"], "embedding"), "user_id", "voice")


@query(
    "weighted_mean_embeddings",
    b.with_cte("clusters")
    + """
SELECT voice, i - 1 AS dim, round(sum(embedding[i] * (1 + cluster_id % 3)) / sum(1 + cluster_id % 3), 6) AS x
FROM clusters, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i) GROUP BY ALL""",
)
def weighted_mean_embeddings(spark, d):
    rows = mean_vectors(b.clusters(spark, d), ["voice"], "embedding", 1 + F.col("cluster_id") % 3)
    return flat(rows, "voice")


@query(
    "centroid_similarity",
    b.with_cte("clusters", "voices")
    + """
SELECT c.cluster_id, round(list_cosine_similarity(c.embedding, v.embedding), 6) AS similarity,
       round(list_cosine_similarity(v.embedding,
         list_transform(v.embedding, lambda x, i: (x * mention_count + c.embedding[i]) / (mention_count + 1))), 6) AS drift
FROM clusters c JOIN voices v ON v.id = c.user_id * 100 + c.voice""",
)
def centroid_similarity(spark, d):
    known = b.voices(spark, d).select("id", F.col("embedding").alias("centroid"), "mention_count")
    rows = b.clusters(spark, d).withColumn("id", F.col("user_id") * 100 + F.col("voice")).join(known, "id")
    moved = running_mean(F.col("centroid"), F.col("embedding"), F.col("mention_count"))
    return rows.select(
        "cluster_id",
        b.r6(cosine(F.col("embedding"), F.col("centroid"))).alias("similarity"),
        b.r6(cosine(F.col("centroid"), moved)).alias("drift"),
    )


SQL_NEAREST = """
scored AS (SELECT c.user_id, c.cluster_id, v.id AS speaker_id, list_cosine_similarity(c.embedding, v.embedding) AS s
           FROM clusters c JOIN voices v USING (user_id)),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY s DESC, speaker_id) AS r FROM scored WHERE s > 0.6)"""


SQL_LINKS = (
    SQL_NEAREST
    + """,
alone AS (SELECT user_id, cluster_id, embedding FROM clusters ANTI JOIN (SELECT cluster_id FROM best WHERE r = 1) USING (cluster_id)),
near AS (SELECT x.user_id, x.cluster_id AS a, y.cluster_id AS b FROM alone x JOIN alone y USING (user_id)
         WHERE x.cluster_id = y.cluster_id OR list_cosine_similarity(x.embedding, y.embedding) >= 0.6),
reach AS (SELECT user_id, a, b FROM near UNION SELECT r.user_id, r.a, n.b FROM reach r JOIN near n ON n.user_id = r.user_id AND n.a = r.b),
links AS (SELECT user_id, cluster_id, speaker_id, false AS is_new FROM best WHERE r = 1
          UNION ALL SELECT user_id, a, -min(b) - 1, true FROM reach GROUP BY user_id, a)"""
)


@query(
    "nearest_speakers",
    b.with_cte("clusters", "voices")
    + ","
    + SQL_NEAREST
    + " SELECT user_id, cluster_id, speaker_id, round(s, 6) AS similarity FROM best WHERE r = 1",
)
def nearest_speakers(spark, d):
    known = b.voices(spark, d).withColumnRenamed("id", "speaker_id")
    rows = nearest(b.clusters(spark, d), known, "user_id", "cluster_id", "speaker_id", threshold=0.6, block=64)
    return rows.select("user_id", "cluster_id", "speaker_id", b.r6("similarity").alias("similarity"))


@query(
    "linked_clusters",
    b.with_cte("clusters", "voices", recursive=True)
    + ","
    + SQL_LINKS
    + """
SELECT user_id, cluster_id, speaker_id, is_new FROM links""",
)
def linked_clusters(spark, d):
    rows = sp.link_frozen(b.clusters(spark, d), b.voices(spark, d))
    return rows.select("user_id", "cluster_id", "speaker_id", "is_new")


@query(
    "centroids_after_linking",
    b.with_cte("clusters", "voices", recursive=True)
    + ","
    + SQL_LINKS
    + """,
weighted AS (SELECT user_id, id AS speaker_id, embedding, mention_count AS w FROM voices
             UNION ALL SELECT l.user_id, speaker_id, embedding, 1 FROM links l JOIN clusters c USING (cluster_id))
SELECT user_id, speaker_id, i - 1 AS dim, round(sum(embedding[i] * w) / sum(w), 6) AS x
FROM weighted, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i) GROUP BY ALL""",
)
def centroids_after_linking(spark, d):
    clusters, known = b.clusters(spark, d), b.voices(spark, d)
    rows = sp.updated_centroids(sp.link_frozen(clusters, known), clusters, known)
    return flat(rows, "user_id", "speaker_id")


SQL_ORDERED = """
items AS (SELECT user_id, cluster_id, label, embedding, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY cluster_id) AS r FROM clusters),
fold AS (
  SELECT DISTINCT user_id, 0::BIGINT AS r, []::STRUCT(id BIGINT, n BIGINT, c DOUBLE[])[] AS known, NULL::BIGINT AS cluster_id, NULL::BIGINT AS speaker_id,
         NULL::BOOLEAN AS is_new, NULL::BIGINT AS mention_count FROM items
  UNION ALL
  SELECT user_id, r, CASE WHEN hit_at IS NULL THEN list_append(known, {'id': cluster_id, 'n': 1::BIGINT, 'c': embedding})
      ELSE list_transform(known, lambda x, i: CASE WHEN i = hit_at THEN {'id': x.id, 'n': x.n + 1,
          'c': list_transform(x.c, lambda v, j: CAST(CAST((v * x.n + embedding[j]) / (x.n + 1) AS FLOAT) AS DOUBLE))} ELSE x END) END,
    cluster_id, CASE WHEN hit_at IS NULL THEN cluster_id ELSE known[hit_at].id END, hit_at IS NULL, CASE WHEN hit_at IS NULL THEN 1 ELSE known[hit_at].n + 1 END
  FROM (SELECT *, CASE WHEN list_max(scores) > 0.2 THEN list_position(scores, list_max(scores)) END AS hit_at
        FROM (SELECT i.user_id, i.r, f.known, i.cluster_id, i.embedding,
                     list_transform(f.known, lambda x: list_cosine_similarity(x.c, i.embedding)) AS scores
              FROM fold f JOIN items i ON i.user_id = f.user_id AND i.r = f.r + 1)))"""


@query(
    "linked_in_order",
    b.with_cte("clusters", recursive=True)
    + ","
    + SQL_ORDERED
    + " SELECT user_id, cluster_id, speaker_id, is_new, CAST(mention_count AS INTEGER) AS mention_count FROM fold WHERE r > 0",
)
def linked_in_order(spark, d):
    rows = sp.link_ordered(b.clusters(spark, d).withColumn("ord", F.col("cluster_id")), threshold=0.2)
    return rows.select("user_id", "cluster_id", "speaker_id", "is_new", "mention_count")


SQL_FROM_REGISTRY = SQL_ORDERED.replace(
    "SELECT DISTINCT user_id, 0::BIGINT AS r, []::STRUCT(id BIGINT, n BIGINT, c DOUBLE[])[] AS known,",
    "SELECT DISTINCT user_id, 0::BIGINT AS r, (SELECT list({'id': id, 'n': mention_count, 'c': embedding} ORDER BY id) FROM voices v WHERE v.user_id = items.user_id) AS known,",
).replace("{'id': cluster_id, 'n': 1::BIGINT", "{'id': -cluster_id - 1, 'n': 1::BIGINT").replace("hit_at IS NULL THEN cluster_id ELSE", "hit_at IS NULL THEN -cluster_id - 1 ELSE")


@query(
    "linked_to_registry_in_order",
    b.with_cte("clusters", "voices", recursive=True)
    + ","
    + SQL_FROM_REGISTRY
    + " SELECT user_id, cluster_id, speaker_id, is_new, CAST(mention_count AS INTEGER) AS mention_count FROM fold WHERE r > 0",
)
def linked_to_registry_in_order(spark, d):
    rows = sp.link_ordered(b.clusters(spark, d).withColumn("ord", F.col("cluster_id")), 0.2, b.voices(spark, d))
    return rows.select("user_id", "cluster_id", "speaker_id", "is_new", "mention_count")


@query(
    "speakers_after_deleting",
    b.with_cte("clusters", "voices")
    + """
SELECT 'speaker' AS part, id, '' AS speaker_id FROM voices WHERE id % 7 > 0
UNION ALL SELECT 'segment', cluster_id, CASE WHEN (user_id * 100 + voice) % 7 > 0 THEN CAST(user_id * 100 + voice AS VARCHAR) ELSE '' END FROM clusters""",
)
def speakers_after_deleting(spark, d):
    known = b.voices(spark, d)
    segments = b.clusters(spark, d).select(F.col("cluster_id").alias("id"), (F.col("user_id") * 100 + F.col("voice")).alias("speaker_id"))
    speakers, cleared = sp.without_speakers(known, segments, known.filter("id % 7 = 0").select("id"))
    rows = speakers.select(F.lit("speaker").alias("part"), "id", F.lit("").alias("speaker_id"))
    return rows.unionByName(cleared.select(F.lit("segment").alias("part"), "id", F.coalesce(F.col("speaker_id").cast("string"), F.lit("")).alias("speaker_id")))


@query(
    "registry_after_ordered_linking",
    b.with_cte("clusters", recursive=True)
    + ","
    + SQL_ORDERED
    + """,
ends AS (SELECT user_id, arg_max(known, r) AS known FROM fold GROUP BY user_id),
voices_ AS (SELECT user_id, unnest(known) AS v FROM ends)
SELECT user_id, v.id AS speaker_id, CAST(v.n AS INTEGER) AS mention_count, i - 1 AS dim, round(v.c[i], 6) AS x
FROM voices_, LATERAL (SELECT unnest(generate_series(1, len(v.c))) AS i)""",
)
def registry_after_ordered_linking(spark, d):
    rows = sp.link_ordered(b.clusters(spark, d).withColumn("ord", F.col("cluster_id")), threshold=0.2)
    return flat(sp.registry_after(rows), "user_id", "speaker_id", "mention_count")


@query(
    "similar_cluster_pairs",
    b.with_cte("clusters")
    + """
SELECT a.session_id, a.label AS a, c.label AS b, round(list_cosine_similarity(a.embedding, c.embedding), 6) AS similarity
FROM clusters a JOIN clusters c ON a.session_id = c.session_id AND a.label < c.label
WHERE list_cosine_similarity(a.embedding, c.embedding) >= 0.2""",
)
def similar_cluster_pairs(spark, d):
    rows = similar_pairs(b.clusters(spark, d), "session_id", "label", threshold=0.2, block=4)
    return rows.select("session_id", "a", "b", b.r6("similarity").alias("similarity"))


SQL_COMPONENTS = """
edges AS (SELECT a.session_id, a.label AS a, c.label AS b FROM clusters a JOIN clusters c
          ON a.session_id = c.session_id AND list_cosine_similarity(a.embedding, c.embedding) >= 0.2),
reach AS (SELECT session_id, a, b FROM edges
          UNION SELECT r.session_id, r.a, e.b FROM reach r JOIN edges e ON e.session_id = r.session_id AND e.a = r.b),
components AS (SELECT session_id, a AS label, min(b) AS survivor FROM reach GROUP BY ALL)"""


@query(
    "similarity_components",
    b.with_cte("clusters", recursive=True) + "," + SQL_COMPONENTS + " SELECT session_id, label, survivor FROM components",
)
def components(spark, d):
    return similarity_components(b.clusters(spark, d), "session_id", "label", threshold=0.2, block=4)


@query(
    "merged_cluster_turns",
    b.with_cte("activity", "spoken", "clusters", recursive=True)
    + ","
    + SQL_COMPONENTS
    + """,
turns AS (SELECT session_id, pos, 'SPEAKER_' || lpad(CAST(k % 12 AS VARCHAR), 2, '0') AS speaker FROM spoken)
SELECT t.session_id, t.pos, COALESCE(c.survivor, t.speaker) AS speaker
FROM turns t LEFT JOIN components c ON c.session_id = t.session_id AND c.label = t.speaker""",
)
def merged_cluster_turns(spark, d):
    turns = b.spoken(spark, d).select(
        "session_id", "pos", F.concat(F.lit("SPEAKER_"), F.lpad((F.col("k") % 12).cast("string"), 2, "0")).alias("speaker")
    )
    return sp.merge_clusters(turns, b.clusters(spark, d), threshold=0.2)


@query(
    "labelled_segments",
    b.with_cte("activity", "spoken", "clusters", recursive=True)
    + ","
    + SQL_COMPONENTS
    + """,
said AS (SELECT s.session_id, s.start_s + 1800 AS start_s, s.end_s + 1800 AS end_s, COALESCE(c.survivor, s.name) AS speaker
         FROM (SELECT *, 'SPEAKER_' || lpad(CAST(k % 12 AS VARCHAR), 2, '0') AS name FROM spoken WHERE k % 4 < 2) s
         LEFT JOIN components c ON c.session_id = s.session_id AND c.label = s.name),
pairs AS (SELECT s.session_id, s.pos, t.speaker,
                 ROW_NUMBER() OVER (PARTITION BY s.session_id, s.pos
                   ORDER BY least(s.end_s, t.end_s) - greatest(s.start_s, t.start_s) DESC, t.start_s, t.end_s) AS r
          FROM spoken s JOIN said t ON s.session_id = t.session_id AND s.start_s < t.end_s AND t.start_s < s.end_s),
labelled AS (SELECT s.session_id, s.pos, s.start_s, s.end_s, COALESCE(p.speaker, s.speaker) AS speaker
             FROM spoken s LEFT JOIN pairs p ON s.session_id = p.session_id AND s.pos = p.pos AND p.r = 1),
talk AS (SELECT session_id, speaker, SUM(end_s - start_s) AS talk_s, MIN(pos) AS first_pos
         FROM labelled WHERE end_s > start_s GROUP BY ALL),
ranks AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY talk_s DESC, first_pos) AS r FROM talk)
SELECT l.session_id, l.pos, CASE WHEN l.session_id % 10 = 3 THEN s.speaker WHEN r = 1 THEN 'USER' ELSE COALESCE('S' || (r - 1), l.speaker) END AS speaker
FROM labelled l JOIN spoken s USING (session_id, pos) LEFT JOIN ranks ON ranks.session_id = l.session_id AND ranks.speaker = l.speaker""",
)
def labelled_segments(spark, d):
    spoken = b.spoken(spark, d)
    turns = spoken.filter("k % 4 < 2").select(
        "session_id",
        (F.col("start") + 1800).alias("start"),
        (F.col("end") + 1800).alias("end"),
        F.concat(F.lit("SPEAKER_"), F.lpad((F.col("k") % 12).cast("string"), 2, "0")).alias("speaker"),
    )
    failed = spoken.filter("session_id % 10 = 3").select("session_id")
    rows = sp.labelled_segments(spoken, turns, b.clusters(spark, d), 0.2, failed, bucket_s=BUCKET_S)
    return rows.select("session_id", "pos", "speaker")


@query(
    "merge_primaries",
    b.with_cte("clusters", "voices")
    + """,
ranked AS (SELECT *, id // 100 AS merge_id, ROW_NUMBER() OVER (PARTITION BY user_id
             ORDER BY name IS NOT NULL DESC, mention_count DESC, created_at, id) AS r FROM voices)
SELECT merge_id, arg_min(id, r) AS id, arg_min(name, r) FILTER (name IS NOT NULL) AS name,
       CAST(sum(greatest(1, mention_count)) AS INTEGER) AS mention_count, bool_or(is_user) AS is_user,
       count(*) AS n_merged
FROM ranked GROUP BY merge_id""",
)
def merge_primaries(spark, d):
    known = b.voices(spark, d)
    selection = known.select(F.floor(F.col("id") / 100).cast("long").alias("merge_id"), "id")
    primaries, mapping = sp.merged_speakers(known, selection)
    sizes = mapping.groupBy(F.col("primary_id").alias("id")).agg(F.count("*").alias("n_merged"))
    return primaries.join(sizes, "id").select("merge_id", "id", "name", "mention_count", "is_user", "n_merged")


@query(
    "merged_centroids",
    b.with_cte("clusters", "voices")
    + """
SELECT user_id AS merge_id, i - 1 AS dim, round(sum(embedding[i] * mention_count) / sum(mention_count), 6) AS x
FROM voices, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i) GROUP BY ALL""",
)
def merged_centroids(spark, d):
    known = b.voices(spark, d)
    selection = known.select(F.col("user_id").alias("merge_id"), "id")
    return flat(sp.merged_speakers(known, selection)[0], "merge_id")


def linked_segments(spark, d):
    """Spoken intervals pointing at speakers ``user * 100 + voice``; some ids are unknown."""
    return b.spoken(spark, d).select(
        "session_id",
        "pos",
        "speaker",
        "start",
        "end",
        (F.col("session_id") % b.USERS * 100 + F.col("k") % 13).alias("speaker_id"),
    )


SQL_LINKED = f"""
linked AS (SELECT session_id, pos, speaker, start_s, end_s, session_id % {b.USERS} * 100 + k % 13 AS speaker_id FROM spoken)"""


@query(
    "segments_after_merge",
    b.with_cte("activity", "spoken", "clusters", "voices")
    + ","
    + SQL_LINKED
    + """,
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY name IS NOT NULL DESC, mention_count DESC, created_at, id) AS r FROM voices),
primaries AS (SELECT user_id, id AS primary_id FROM ranked WHERE r = 1)
SELECT l.session_id, l.pos, CAST(COALESCE(p.primary_id, l.speaker_id) AS VARCHAR) AS speaker_id
FROM linked l LEFT JOIN voices v ON v.id = l.speaker_id LEFT JOIN primaries p ON p.user_id = v.user_id""",
)
def segments_after_merge(spark, d):
    known = b.voices(spark, d)
    _, mapping = sp.merged_speakers(known, known.select(F.col("user_id").alias("merge_id"), "id"))
    rows = linked_segments(spark, d).withColumn("speaker_id", F.col("speaker_id").cast("string"))
    return sp.rewritten_segments(rows, mapping).select("session_id", "pos", "speaker_id")


@query(
    "resolved_names",
    b.with_cte("activity", "spoken", "clusters", "voices")
    + ","
    + SQL_LINKED
    + """
SELECT l.session_id, l.pos, v.id IS NOT NULL AS linked, COALESCE(v.name, l.speaker) AS display
FROM linked l LEFT JOIN voices v ON v.id = l.speaker_id""",
)
def resolved_names(spark, d):
    rows = tr.resolved_names(linked_segments(spark, d), b.voices(spark, d))
    return rows.select("session_id", "pos", "linked", "display")


@query(
    "speaker_rows",
    b.with_cte("activity", "spoken", "clusters", "voices")
    + ","
    + SQL_LINKED
    + """,
firsts AS (SELECT session_id, speaker, min(pos) AS first_pos, arg_min(speaker_id, pos) AS speaker_id FROM linked GROUP BY ALL),
rows_ AS (SELECT f.*, v.id IS NOT NULL AS linked FROM firsts f LEFT JOIN voices v ON v.id = f.speaker_id)
SELECT session_id, linked, CASE WHEN linked THEN CAST(speaker_id AS VARCHAR) END AS speaker_id,
       string_agg(speaker, ',' ORDER BY first_pos) AS labels, min(first_pos) AS first_pos
FROM rows_ GROUP BY session_id, linked, CASE WHEN linked THEN CAST(speaker_id AS VARCHAR) ELSE speaker END, CASE WHEN linked THEN CAST(speaker_id AS VARCHAR) END""",
)
def speaker_rows(spark, d):
    rows = tr.speaker_rows(linked_segments(spark, d), b.voices(spark, d))
    return rows.withColumn("speaker_id", F.col("speaker_id").cast("string"))


@query(
    "promoted_wearer",
    b.with_cte("activity", "spoken", "clusters", "voices")
    + ","
    + SQL_LINKED
    + """,
talk AS (SELECT session_id, speaker, SUM(end_s - start_s) AS talk_s, MIN(pos) AS p FROM linked GROUP BY ALL),
ranks AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY talk_s DESC, p) AS r FROM talk),
named AS (SELECT l.session_id, l.pos, l.start_s, l.end_s, l.speaker_id, CASE WHEN r = 1 THEN 'USER' ELSE 'S' || (r - 1) END AS speaker
          FROM linked l JOIN ranks USING (session_id, speaker)),
per AS (SELECT n.session_id, n.speaker_id, SUM(end_s - start_s) AS t, MIN(pos) AS p, arg_min(n.speaker, pos) AS label
        FROM named n JOIN voices v ON v.id = n.speaker_id AND v.is_user GROUP BY ALL),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t DESC, p) AS r FROM per)
SELECT n.session_id, n.pos, CASE WHEN t.label IS NULL OR t.label = 'USER' THEN n.speaker
   WHEN n.speaker = 'USER' THEN t.label WHEN n.speaker = t.label THEN 'USER' ELSE n.speaker END AS speaker
FROM named n LEFT JOIN top t ON t.session_id = n.session_id AND t.r = 1""",
)
def promoted_wearer(spark, d):
    named = tr.relabel_by_talk_time(linked_segments(spark, d))
    return tr.promote_known_wearer(named, b.voices(spark, d)).select("session_id", "pos", "speaker")


@query(
    "speakers_by_mentions",
    b.with_cte("clusters", "voices")
    + " SELECT user_id, id, name, CAST(mention_count AS INTEGER) AS mention_count FROM voices ORDER BY mention_count DESC, created_at DESC, id",
)
def speakers_by_mentions(spark, d):
    return ar.speakers_by_mentions(b.voices(spark, d)).select(
        "user_id", "id", "name", "mention_count"
    )


@query(
    "embedding_codec",
    "SELECT vec_id, octet_length(CAST(repeat('abcd', len(embedding)) AS BLOB)) AS n_bytes, true AS same FROM embeddings",
)
def embedding_codec(spark, d):
    from parlance.sources.tables import decode_embedding, encode_embedding

    coded = given(spark, d, "embeddings").withColumn("blob", encode_embedding("embedding"))
    back = coded.withColumn("back", decode_embedding("blob"))
    return back.select(
        "vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (F.col("back") == F.col("embedding")).alias("same")
    )


@query(
    "missing_merge_ids",
    b.with_cte("clusters", "voices") + " SELECT DISTINCT user_id, cluster_id AS id FROM clusters WHERE cluster_id NOT IN (SELECT id FROM voices)",
)
def missing_merge_ids(spark, d):
    wanted = b.clusters(spark, d).select("user_id", F.col("cluster_id").alias("id"))
    return sp.missing_selection(b.voices(spark, d).select(F.col("id").alias("v")).join(wanted, F.col("v") == F.col("id")).select("user_id", "id"), wanted)


@query(
    "registry_after_merge",
    b.with_cte("clusters", "voices")
    + """,
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY name IS NOT NULL DESC, mention_count DESC, created_at, id) AS r FROM voices)
SELECT arg_min(id, r) AS id, arg_min(name, r) FILTER (name IS NOT NULL) AS name, CAST(sum(mention_count) AS INTEGER) AS mention_count, bool_or(is_user) AS is_user
FROM ranked GROUP BY user_id""",
)
def registry_after_merge(spark, d):
    known = b.voices(spark, d)
    primaries, mapping = sp.merged_speakers(known, known.select(F.col("user_id").alias("merge_id"), "id"))
    return sp.after_merge(known, primaries, mapping).select("id", "name", "mention_count", "is_user")


@query(
    "updated_previews",
    b.with_cte("activity", "spoken", "clusters", "voices")
    + ","
    + SQL_LINKED
    + """,
clips AS (SELECT speaker_id, session_id, start_s, least(end_s, start_s + 15) - start_s AS len, pos FROM linked),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY speaker_id ORDER BY len DESC, pos) AS r FROM clips)
SELECT v.id, CASE WHEN b.len > 9 THEN CAST(b.session_id AS VARCHAR) END AS preview_session FROM voices v LEFT JOIN best b ON b.speaker_id = v.id AND b.r = 1""",
)
def updated_previews(spark, d):
    stored = b.voices(spark, d).select(
        "id", F.lit(None).cast("long").alias("preview_audio_session_id"), F.lit(1.0).alias("preview_start_s"), F.lit(10.0).alias("preview_end_s")
    )
    clips = linked_segments(spark, d).withColumnRenamed("pos", "ord")
    rows = sp.updated_previews(stored, clips)
    return rows.select("id", F.col("preview_audio_session_id").cast("string").alias("preview_session"))


@query(
    "segments_with_speaker_ids",
    b.with_cte("activity", "spoken", "clusters", "voices", recursive=True)
    + ","
    + SQL_LINKS
    + """
SELECT s.session_id, s.pos, CAST(l.speaker_id AS VARCHAR) AS speaker_id FROM
 (SELECT session_id, pos, 'SPEAKER_' || lpad(CAST(k % 12 AS VARCHAR), 2, '0') AS speaker FROM spoken) s
LEFT JOIN (SELECT session_id, label, speaker_id FROM links JOIN clusters USING (cluster_id)) l ON l.session_id = s.session_id AND l.label = s.speaker""",
)
def segments_with_speaker_ids(spark, d):
    clusters = b.clusters(spark, d)
    links = sp.link_frozen(clusters, b.voices(spark, d)).join(
        clusters.select("cluster_id", "session_id", "label"), "cluster_id"
    )
    rows = b.spoken(spark, d).select(
        "session_id", "pos", F.concat(F.lit("SPEAKER_"), F.lpad((F.col("k") % 12).cast("string"), 2, "0")).alias("speaker")
    )
    return sp.with_speaker_ids(rows, links).select("session_id", "pos", "speaker_id")
