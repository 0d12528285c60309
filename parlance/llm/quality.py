"""Quality of texts: nearest labelled neighbours in a latent-semantic space vote.

1. Terms of a text are its words' shapes (runs of letters, capitals, digits as one sign each), pairs of consecutive shapes, shapes of
   words that repeat the word before them, and the words. Each kind is hashed into its own share of ``TERMS`` places. A place's
   weight is log(1 + count) times its inverse document frequency; words weigh ``WORD_WEIGHT`` of it. Rows have unit length.
2. Document frequencies and the terms' products, summed over all texts, give the ``RANK`` strongest latent directions.
3. Labelled rows, a bounded sample of ``CLASS_ROWS`` of each class, are projected and broadcast. Every text is projected and compared
   with all of them in blocks; the ``NEIGHBOURS`` nearest vote (and all that are as near as the last of them), by the cosine to
   the power ``SHARPNESS``, each class as strong as it is among all labelled rows.

Sums are over integers, so they don't depend on the order of rows or a repeated task.

Cases: a null or empty text has no terms and scores the share of label 1; without labels of both classes every score is that
share, without labels it is 0.5; labels without value or id are not used, of several labels of an id the highest counts, of several texts
of an id the one with the least hash teaches; a document without id is scored, and is not held out; repeated rows are
scored alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import words as W
from parlance.session import parallelism, settle

#: Places of single shapes, pairs, repeated words, words.
SHARES = (192, 256, 64, 256)
TERMS = sum(SHARES)
WORD_WEIGHT = 0.5
RANK = 48
#: Labelled rows of each class that are learned from, at most: the first by a hash of their id.
CLASS_ROWS = 3_000
NEIGHBOURS, SHARPNESS = 15, 8
FOLDS, HELD_FOLD = 4, 2
#: Unit rows are summed as integers of this size.
GRAIN = 1024
#: Rows whose terms are counted, and compared, at a time.
ROWS = 512

_SIGN = np.arange(256, dtype=np.uint8)
_SIGN[48:58], _SIGN[65:91], _SIGN[97:123], _SIGN[128:] = 48, 65, 97, 97


def counted_terms(column: pa.Array) -> np.ndarray:
    """Counts of all places, a row per text."""
    found = W.words_of(column)
    sign = _SIGN[found.raw]
    kept = np.ones(len(sign), dtype=bool)
    kept[1:] = sign[1:] != sign[:-1]
    kept[found.start] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shape = W._hashes(sign[kept], place[found.start], place[found.end] - place[found.start], seed=7)
    row = np.repeat(np.arange(len(column)), np.diff(found.first))
    word = W.words_of(column, lower=True, seed=11).hash
    beside = row[1:] == row[:-1]
    again = beside & (word[1:] == word[:-1])
    with np.errstate(over="ignore"):
        pair = W.mix(shape[1:] * W.GOLDEN + shape[:-1])
    out = np.zeros(len(column) * TERMS, dtype=np.int64)
    base = 0
    for size, rows, marks in zip(SHARES, (row, row[1:][beside], row[1:][again], row), (shape, pair[beside], shape[1:][again], word)):
        at = rows * TERMS + base + (marks % np.uint64(size)).astype(np.int64)
        out += np.bincount(at, minlength=len(out))
        base += size
    return out.reshape(len(column), TERMS)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of few rows and about a quarter of a megabyte of text."""
    for whole in batches:
        for part in W.slices(whole, text, 1 << 18):
            for at in range(0, part.num_rows, ROWS):
                yield part.slice(at, ROWS)


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * weight
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each place, and texts, of all rows of ``text``; a number per place reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, dtype=np.int64)
        for block in blocks(batches):
            counts = counted_terms(block.column(0))
            total[:TERMS] += (counts > 0).sum(axis=0)
            total[TERMS] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(total)], names=["term", "texts"])

    rows = docs.mapInArrow(count, "term int, texts long").groupBy("term").agg(F.sum("texts").alias("texts")).toArrow()
    out = np.zeros(TERMS + 1, dtype=np.int64)
    out[rows.column("term").to_numpy()] = rows.column("texts").to_numpy()
    return out[:TERMS], int(out[TERMS])


def term_products(docs: DataFrame, weight: np.ndarray) -> np.ndarray:
    """The matrix of the terms' products summed over all texts; one matrix per task is shuffled, one reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, TERMS))
        for block in blocks(batches):
            rows = np.rint(weighted(counted_terms(block.column(0)), shared.value) * GRAIN)
            total += rows.T @ rows  # whole numbers below 2^53: exact in any order
        lines = [line.astype(np.int64).tobytes() for line in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS, dtype=np.int32)), pa.array(lines, pa.binary())], names=["term", "line"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # lines of this partition's terms
        for batch in batches:
            for term, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = sums.get(term)
                line = np.frombuffer(line, dtype=np.int64)
                sums[term] = line.copy() if known is None else known + line
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["term", "line"])

    ddl = "term int, line binary"
    lines = docs.mapInArrow(multiply, ddl).repartition(min(64, parallelism(docs)), "term").mapInArrow(add, ddl).toArrow()
    out = np.zeros((TERMS, TERMS))
    for term, line in zip(lines.column("term").to_pylist(), lines.column("line").to_pylist()):
        out[term] = np.frombuffer(line, dtype=np.int64)
    return out


@dataclass
class Space:
    """Term weights and latent directions."""

    weight: np.ndarray
    directions: np.ndarray

    def vectors(self, column: pa.Array) -> np.ndarray:
        """Unit vectors of texts; zero where a text has no terms."""
        rows = weighted(counted_terms(column), self.weight) @ self.directions
        return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12) * (np.abs(rows).max(axis=1, initial=0, keepdims=True) > 1e-9)


def latent_space(docs: DataFrame, rank: int = RANK) -> Space:
    """The space of all rows of ``text``."""
    texts_with, texts = document_frequencies(docs)
    weight = np.log((texts + 1) / (texts_with + 1)) + 0.01
    weight[TERMS - SHARES[-1] :] *= WORD_WEIGHT
    products = term_products(docs, weight)
    _, vectors = np.linalg.eigh(products / max(1, texts) / GRAIN**2)
    return Space(weight, np.ascontiguousarray(vectors[:, ::-1][:, :rank]))


def learnable(labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, label`` of the labelled ids outside the held-out fold, each once."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    return known.filter(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_FOLD)


@dataclass
class Neighbours:
    """Unit vectors of labelled rows, their labels, what a row stands for, and the share of label 1."""

    vectors: np.ndarray
    label: np.ndarray
    stands_for: np.ndarray
    share: float

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), self.share)
        if not 0 < self.label.sum() < len(self.label):
            return out
        near = min(NEIGHBOURS, len(self.label))
        for at in range(0, len(vectors), ROWS):
            cosine = np.rint(vectors[at : at + ROWS] @ self.vectors.T * 1e6) / 1e6
            last = np.partition(cosine, -near, axis=1)[:, -near][:, None]
            votes = np.where((cosine >= last) & (cosine > 0), cosine, 0) ** SHARPNESS * self.stands_for
            total = votes.sum(axis=1)
            voted = total > 0
            out[at : at + ROWS][voted] = (votes @ self.label)[voted] / total[voted]
        return np.clip(out, 0, 1)


def neighbours(docs: DataFrame, labels: DataFrame, space: Space, class_rows: int = CLASS_ROWS, label: str = "quality") -> Neighbours:
    """The labelled sample in the space: at most ``class_rows`` rows of each class, whose ids are broadcast and whose vectors reach the driver."""
    taught = settle(learnable(labels, label).select("doc_id", (F.col("label") > 0).cast("int").alias("label")), "quality-labels")
    picked = [taught.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_rows) for value in (0, 1)]
    sample = settle(picked[0].unionAll(picked[1]), "quality-sample")
    total = {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            vectors = [v.tobytes() for v in shared.value.vectors(block.column(2))]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), block.column(3), pa.array(vectors, pa.binary())], names=["doc_id", "label", "hash", "vector"])

    texts = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text", F.xxhash64("text").alias("hash"))
    projected = texts.mapInArrow(project, "doc_id long, label int, hash long, vector binary")
    one = projected.groupBy("doc_id").agg(F.min_by(F.struct("label", "vector"), "hash").alias("row")).select("doc_id", "row.*").orderBy("doc_id").toArrow()
    known = one.column("label").to_numpy().astype(np.float64)
    vectors = np.array([np.frombuffer(v) for v in one.column("vector").to_pylist()]).reshape(len(known), space.directions.shape[1])
    counts = {value: max(1, int((known == value).sum())) for value in (0, 1)}
    stands_for = np.array([total.get(int(v), 0) / counts[int(v)] for v in known])
    labelled = sum(total.values())
    return Neighbours(vectors, known, stands_for, total.get(1, 0) / labelled if labelled else 0.5)


def scores(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score`` of every row."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    space = latent_space(read.select("text"))
    shared = docs.sparkSession.sparkContext.broadcast((space, neighbours(read, labels, space, class_rows, label)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, known = shared.value
        for block in blocks(batches):
            found = known.scores(space.vectors(block.column(2)))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(found)], names=["doc_id", "held_out", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_FOLD, F.lit(False))
    return read.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double")
