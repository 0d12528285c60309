"""Line dedup by overlapping windows of three lines, in built-in functions only.

Each document's lines are hashed in overlapping windows of ``width`` consecutive lines. Of windows with equal
lines the first occurrence, by document id and then position, stays; every later one marks the lines it covers, and
the union of the covered positions is removed.

Cases: lines end at ``\\n`` and compare as they are; a null text has no lines and stays null; a document with fewer
lines than a window is left alone; a null id is lower than every other; rows that are equal in id and text
are one document, so neither is later than the other; an empty table gives an empty result; further columns travel along,
whatever their names, but for ``n_lines`` and ``n_removed``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.names import free_names

WIDTH = 3


def line_windows(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, text_hash, at, h1, h2``: one row per window; two 64-bit hashes stand for its lines."""
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.split(text_col, "\n", -1).alias("lines"))
    lines = lines.filter(F.size("lines") >= width)

    def window(i):
        inside = [F.get("lines", i + j) for j in range(width)]
        return F.struct(i.alias("at"), F.xxhash64(*inside).alias("h1"), F.xxhash64(F.lit(width), *inside[::-1]).alias("h2"))

    spots = F.transform(F.sequence(F.lit(0), F.size("lines") - F.lit(width)), window)
    return lines.select("doc", "text_hash", F.inline(spots))


def repeated_positions(windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc, text_hash, covered``: the distinct line numbers that later occurrences cover.

    A window that many documents share is summed before it travels; joining back, Spark can split its rows.
    """
    place = F.struct(F.col("doc").alias("doc"), F.col("text_hash").alias("text_hash"), F.col("at").alias("at"))
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("seen")).filter("seen > 1").drop("seen")
    later = windows.join(firsts, ["h1", "h2"]).filter(F.col("first") < place)
    covered = F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.lit(width - 1))))
    return later.groupBy("doc", "text_hash").agg(F.array_distinct(covered).alias("covered"))


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the kept lines as text, plus ``n_lines`` and ``n_removed``."""
    marks = repeated_positions(line_windows(docs, width, id_col, text_col), width)
    docs = docs.drop("n_lines", "n_removed")
    key, doc, text_hash, covered = free_names(docs, "dedup_key", "dedup_doc", "dedup_hash", "dedup_covered")
    marks = marks.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("covered").alias(covered))
    marked = docs.withColumn(key, F.xxhash64(text_col)).join(marks, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_hash)), "left")
    lines = F.split(text_col, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - F.lit(1)), F.col(covered))
    text = F.when(F.col(covered).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    count = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.coalesce(F.size(covered), F.lit(0)).cast("long")
    removed = F.when(F.col(covered).isNull(), F.lit(0).cast("long")).otherwise(removed)
    others = [docs[c] for c in docs.columns if c != text_col]
    return marked.select(*others, text.alias(text_col), count.alias("n_lines"), removed.alias("n_removed"))
