"""Row-level helpers: newest rows, keyed updates and removals, closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import settle


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, combined map-side."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select("__row.*")


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key.  Spark limits each key before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def updated(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], order: str = "changed_at") -> DataFrame:
    """New version of ``df``: rows named in ``changes`` take its columns, also nulls.

    Of several changes of a row the newest by ``order`` counts, where ``changes`` has that column; else, and among equally
    new ones, the one with the greatest values. No change ever doubles a row.
    """
    by = F.struct(*[F.col(c) for c in ([order] if order in changes.columns else [])], *[F.col(c) for c in columns])
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), by).alias("__new"))
    new = last.select(key, F.lit(True).alias("__hit"), *[F.col("__new")[c].alias(f"__{c}") for c in columns])
    hit = F.coalesce("__hit", F.lit(False))
    return (
        df.join(new, key, "left")
        .withColumns({c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns})
        .select(*df.columns)
    )


def without(df: DataFrame, ids: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Rows whose ``column`` is not among the ids."""
    return df.join(ids.select(F.col(id_column).alias(column)).distinct(), column, "left_anti").select(*df.columns)


def descendants(df: DataFrame, roots: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Ids of the roots and of everything below them, level by level."""
    links = df.filter(F.col(parent).isNotNull()).select(F.col(key).alias("child"), F.col(parent).alias(key))
    found = frontier = settle(roots.select(key).distinct().join(df.select(key), key, "left_semi"), "roots")
    while True:
        below = links.join(frontier, key).select(F.col("child").alias(key)).distinct()
        frontier = settle(below.join(found, key, "left_anti"), "level")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
