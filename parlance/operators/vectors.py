"""Means, nearest matches and similarity components of embeddings.

Comparisons run block against block: a group is cut into blocks of a fixed number of
vectors, each pair of blocks is one bounded task, and a task emits its best match per
query (or a spanning forest), never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from parlance.session import parallelism, settle

BLOCK = 2048


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Mean (or weighted mean) vector per key, combined map-side."""
    column = array_to_vector(F.col(vector).cast("array<double>"))
    mean = Summarizer.mean(column) if weight is None else Summarizer.mean(column, weight.cast("double"))
    return df.groupBy(*keys).agg(vector_to_array(mean).alias(vector))


def _unit(vectors) -> np.ndarray:
    matrix = np.vstack([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _blocks(df: DataFrame, group: str, name: str, block: int) -> DataFrame:
    """Number of blocks of each group."""
    return df.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name))


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    group: str,
    query_id: str,
    candidate_id: str,
    vector: str = "embedding",
    threshold: float = 0.6,
    block: int = BLOCK,
) -> DataFrame:
    """Best candidate of the same group with similarity strictly above the threshold.

    Ties go to the smallest candidate id.  Returns ``group, query_id, candidate_id,
    similarity`` for queries that have a match.
    """
    q = queries.filter(F.col(vector).isNotNull()).select(group, query_id, vector)
    c = candidates.filter(F.col(vector).isNotNull()).select(group, candidate_id, vector)
    sizes = _blocks(q, group, "nq", block).join(_blocks(c, group, "nc", block), group)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blank = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    left = q.join(sizes, group).select(
        group,
        F.expr(f"pmod(xxhash64({query_id}), nq)").cast("int").alias("bq"),
        every("nc").alias("bc"),
        query_id,
        blank(c, candidate_id),
        vector,
    )
    right = c.join(sizes, group).select(
        group,
        every("nq").alias("bq"),
        F.expr(f"pmod(xxhash64({candidate_id}), nc)").cast("int").alias("bc"),
        blank(q, query_id),
        candidate_id,
        vector,
    )
    schema = left.select(group, query_id, candidate_id).schema.add("similarity", "double")

    def best(part: pd.DataFrame) -> pd.DataFrame:
        is_query = part[query_id].notna()
        qs, cs = part[is_query], part[~is_query].sort_values(candidate_id)
        widths = cs[vector].map(len)
        found = []
        # Only vectors of the same length are comparable.
        for width, rows in qs.groupby(qs[vector].map(len)):
            same = cs[widths == width]
            if same.empty:
                continue
            scores = _unit(rows[vector]) @ _unit(same[vector]).T
            at = scores.argmax(axis=1)
            top = scores[np.arange(len(rows)), at]
            hit = top > threshold
            found.append(
                pd.DataFrame(
                    {
                        group: rows[group].to_numpy()[hit],
                        query_id: rows[query_id].to_numpy()[hit],
                        candidate_id: same[candidate_id].to_numpy()[at[hit]],
                        "similarity": top[hit],
                    }
                )
            )
        if not found:
            return pd.DataFrame({n: pd.Series(dtype="object") for n in schema.fieldNames()})
        return pd.concat(found)

    blocks = left.unionByName(right).repartition(parallelism(q), group, "bq", "bc")
    scored = blocks.groupBy(group, "bq", "bc").applyInPandas(best, schema)
    ranked = scored.groupBy(group, query_id).agg(F.max("similarity").alias("similarity"), F.min_by(
        candidate_id, F.struct(-F.col("similarity"), F.col(candidate_id))
    ).alias(candidate_id))
    return ranked.select(group, query_id, candidate_id, "similarity")


def _block_pairs(df: DataFrame, group: str, node: str, vector: str, block: int) -> DataFrame:
    """Every vector in each pair of blocks that it takes part in."""
    sized = df.select(group, node, vector).join(_blocks(df, group, "nb", block), group)
    own = F.expr(f"pmod(xxhash64({node}), nb)").cast("int")
    placed = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return placed.select(
        group, F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", node, vector
    ).repartition(parallelism(df), group, "b1", "b2")


def similar_pairs(
    df: DataFrame, group: str, node: str, vector: str = "embedding", threshold: float = 0.6, block: int = BLOCK
) -> DataFrame:
    """Pairs ``a < b`` of one group whose similarity reaches the threshold, with the similarity."""
    df, named = _by_width(df, group, vector)
    pairs = _block_pairs(df, group, node, vector, block)
    kind = df.schema[node].dataType
    schema = df.select(group).schema.add("a", kind).add("b", kind).add("similarity", "double")

    def edges(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(node)
        unit = _unit(part[vector])
        ids, own = part[node].to_numpy(), part["own"].to_numpy()
        split = part["b1"].iloc[0] != part["b2"].iloc[0]
        hits = []
        for i in range(len(ids) - 1):
            scores = unit[i + 1 :] @ unit[i]
            hit = scores >= threshold
            if split:  # pairs inside one block belong to that block's own task
                hit &= own[i + 1 :] != own[i]
            at = np.flatnonzero(hit)
            hits.append((np.full(len(at), i), at + i + 1, scores[at]))
        if not hits:
            return pd.DataFrame({n: pd.Series(dtype="object") for n in schema.fieldNames()})
        left, right, scores = (np.concatenate(column) for column in zip(*hits))
        out = pd.DataFrame({"a": ids[left], "b": ids[right], "similarity": scores})
        out[group] = part[group].iloc[0]
        return out[schema.fieldNames()]

    return named(pairs.groupBy(group, "b1", "b2").applyInPandas(edges, schema))


def _by_width(df: DataFrame, group: str, vector: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Groups split by vector width, and what gives a result its group again.

    Vectors of different width have similarity 0, and a missing one has no similarity.
    """
    kind = df.schema[group].dataType
    split = df.filter(F.col(vector).isNotNull()).withColumn(group, F.to_json(F.struct(F.col(group).alias("g"), F.size(vector).alias("w"))))
    shape = StructType().add("g", kind).add("w", IntegerType())
    return split, lambda out: out.withColumn(group, F.from_json(F.col(group), shape)["g"])


def similarity_components(
    df: DataFrame, group: str, node: str, vector: str = "embedding", threshold: float = 0.6, block: int = BLOCK
) -> DataFrame:
    """Connected components of similarity within each group: ``group, node, survivor``.

    The survivor is the smallest node of the component.  Each block pair is reduced to a
    spanning forest; forests of groups with several blocks are then joined by label
    propagation.
    """
    df, named = _by_width(df, group, vector)
    pairs = _block_pairs(df, group, node, vector, block)
    kind = df.schema[node].dataType
    schema = df.select(group).schema.add(node, kind).add("survivor", kind)

    def forest(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(node)
        unit = _unit(part[vector])
        free = np.ones(len(part), dtype=bool)
        root = np.arange(len(part))
        # Breadth-first from the smallest free node: it is the root of its component.
        for start in range(len(part)):
            if not free[start]:
                continue
            free[start] = False
            front = np.array([start])
            while front.size:
                rest = np.nonzero(free)[0]
                if not rest.size:
                    break
                near = rest[((unit[rest] @ unit[front].T) >= threshold).any(axis=1)]
                free[near] = False
                root[near] = start
                front = near
        ids = part[node].to_numpy()
        return pd.DataFrame({group: part[group].to_numpy(), node: ids, "survivor": ids[root]})

    stars = settle(pairs.groupBy(group, "b1", "b2").applyInPandas(forest, schema).distinct(), "forest")
    return named(_propagate(stars, group, node))


def _propagate(stars: DataFrame, group: str, node: str) -> DataFrame:
    """Smallest reachable node over star edges ``node - survivor``."""
    labels = settle(stars.groupBy(group, node).agg(F.min("survivor").alias("survivor")), "labels")
    edges = stars.filter(F.col(node) != F.col("survivor")).select(
        group, F.col(node).alias("a"), F.col("survivor").alias("b")
    )
    both = settle(edges.unionByName(edges.select(group, F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    # A node that sits in one star only needs no round: every group of one block is done.
    while True:
        known = labels.select(group, F.col(node).alias("a"), F.col("survivor").alias("label"))
        heard = both.join(known, [group, "a"]).groupBy(group, "b").agg(F.min("label").alias("heard"))
        moved = labels.join(heard.withColumnRenamed("b", node), [group, node], "left").select(
            group, node, F.least("survivor", "heard").alias("next"), "survivor"
        )
        step = settle(
            moved.select(group, node, F.col("next").alias("survivor"), (F.col("next") != F.col("survivor")).alias("moved")),
            "labels",
        )
        if step.filter("moved").isEmpty():
            return step.select(group, node, "survivor")
        # Jump: follow the label of the label, so that long chains halve each round.
        hop = step.select(group, F.col(node).alias("survivor"), F.col("survivor").alias("further"))
        labels = settle(
            step.join(hop, [group, "survivor"], "left").select(
                group, node, F.least("survivor", "further").alias("survivor")
            ),
            "labels",
        )
