"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``min_match`` tokens that a document and a benchmark item share; the seed join finds the (document,
item) pairs. A pair is tiled: the longest common run of tokens that no tile covers yet is marked, again and again,
down to ``min_match`` tokens, so a passage whose parts were put in another order is still covered. Common runs of
a length are found by running Karp-Rabin hashes over the unmarked stretches and confirmed token by token. A
document is contaminated by an item if its tiles cover at least ``coverage`` of the item's tokens.

Tokens are the words of the text in lower case (A-Z) without punctuation at their ends. An item shorter than
``min_match`` is sought as a whole.

Cases: null or blank texts and items have no tokens and match nothing; equal items each match; repeated
documents are judged each by their own text; ids may be null; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import words as W
from parlance.llm.names import free_names
from parlance.session import settle

MIN_MATCH, COVERAGE = 5, 0.5
#: Seeds (12 bytes each in a task) up to which every task gets all of them; beyond it they are joined by a shuffle.
SHIPPED_SEEDS = 2_000_000

_EDGE = np.ones(256, dtype=bool)  # ASCII bytes that are dropped at the ends of a word
_EDGE[48:58] = _EDGE[65:91] = _EDGE[97:123] = _EDGE[128:] = False

RESULT = "doc_id long, text_hash long, item_id long, n_tokens int, n_covered int, n_tiles int, covered double"


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows and each row's first token (one entry more than rows)."""
    found = W.words_of(column, lower=True)
    start, end = found.start.copy(), found.end.copy()
    open_rows = np.arange(len(start))
    while len(open_rows):
        open_rows = open_rows[(start[open_rows] < end[open_rows]) & _EDGE[found.raw[np.minimum(start[open_rows], len(found.raw) - 1)]]]
        start[open_rows] += 1
    open_rows = np.arange(len(start))
    while len(open_rows):
        open_rows = open_rows[(start[open_rows] < end[open_rows]) & _EDGE[found.raw[end[open_rows] - 1]]]
        end[open_rows] -= 1
    filled = end > start
    before = np.concatenate([[0], np.cumsum(filled)])
    return W._hashes(found.raw, start[filled], (end - start)[filled], seed=3), before[found.first]


def seeds_of(tokens: np.ndarray, min_match: int) -> np.ndarray:
    """Seed hashes of an item or document; a short one is one seed of its own length."""
    width = min(min_match, len(tokens))
    return W.runs(tokens, width, seed=100 + width) if width else np.zeros(0, dtype=np.uint64)


# ---------------------------------------------------------------- tiling


def _rolling(tokens: np.ndarray, open_: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the unmarked stretches of ``length`` tokens, from prefix sums modulo 2^64."""
    if len(tokens) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    free = np.concatenate([[0], np.cumsum(open_)])
    start = np.flatnonzero(free[length:] - free[:-length] == length)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        powers = np.ones(len(tokens) + 1, dtype=np.uint64)
        np.multiply.accumulate(np.full(len(tokens), base, dtype=np.uint64), out=powers[1:])
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(tokens * powers[:-1], dtype=np.uint64)])
        # the power is odd, so stretches at different places compare after scaling to the last place
        return start, (prefix[start + length] - prefix[start]) * powers[len(tokens) - start]


def _longest(item: np.ndarray, doc: np.ndarray, item_open: np.ndarray, doc_open: np.ndarray, low: int) -> int:
    """Length of the longest common unmarked run, 0 if below ``low``: doubling and halving over Karp-Rabin tables."""

    def shared(length: int) -> bool:
        _, a = _rolling(item, item_open, length)
        if not len(a):
            return False
        _, b = _rolling(doc, doc_open, length)
        scale = _scale(len(item), len(doc))
        return bool(np.isin(a * scale[0], b * scale[1]).any())

    if not shared(low):
        return 0
    good, bad = low, low * 2
    while bad <= len(item) and shared(bad):
        good, bad = bad, bad * 2
    bad = min(bad, len(item) + 1)
    while bad - good > 1:
        middle = (good + bad) // 2
        good, bad = (middle, bad) if shared(middle) else (good, middle)
    return good


def _scale(item_size: int, doc_size: int) -> tuple[np.uint64, np.uint64]:
    """Factors that bring hashes of two token rows of different size to the same last place."""
    base, gap = 0x9E3779B97F4A7C15, abs(doc_size - item_size)
    power = np.uint64(pow(base, gap, 1 << 64))
    return (power, np.uint64(1)) if doc_size > item_size else (np.uint64(1), power)


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: ``(place in item, place in doc, length)``, longest first, ties by place."""
    low = max(1, min(min_match, len(item)))
    item_open, doc_open, out = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool), []
    scale = _scale(len(item), len(doc))
    while length := _longest(item, doc, item_open, doc_open, low):
        at_item, hash_item = _rolling(item, item_open, length)
        at_doc, hash_doc = _rolling(doc, doc_open, length)
        with np.errstate(over="ignore"):
            hash_item, hash_doc = hash_item * scale[0], hash_doc * scale[1]
        near = np.isin(hash_doc, hash_item)
        at_doc, hash_doc = at_doc[near], hash_doc[near]
        order = np.argsort(hash_doc, kind="stable")
        sorted_hash = hash_doc[order]
        marked = False
        for a, value in zip(at_item, hash_item):
            if not item_open[a : a + length].all():
                continue
            for k in order[np.searchsorted(sorted_hash, value) : np.searchsorted(sorted_hash, value, side="right")]:
                b = at_doc[k]
                if doc_open[b : b + length].all() and (item[a : a + length] == doc[b : b + length]).all():
                    item_open[a : a + length] = doc_open[b : b + length] = False
                    out.append((int(a), int(b), length))
                    marked = True
                    break
        if not marked:  # equal hashes of different tokens only
            break
    return out


# ---------------------------------------------------------------- jobs


def item_seeds(items: DataFrame, min_match: int, id_col: str, text_col: str) -> DataFrame:
    """``seed, n_tokens, item_no, item_id, tokens``: one row per distinct seed of an item."""
    schema = pa.schema([("item_id", pa.int64()), ("tokens", pa.binary()), ("seeds", pa.list_(pa.int64())), ("size", pa.int32())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, first = token_hashes(batch.column(1))
            rows = [tokens[first[i] : first[i + 1]] for i in range(batch.num_rows)]
            seeds = [np.unique(seeds_of(r, min_match)).view(np.int64) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.array([min(len(r), min_match) for r in rows], pa.int32())],
                schema=schema,
            )

    read = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(compute, "item_id long, tokens binary, seeds array<long>, size int").filter("size > 0")


def _doc_seeds(tokens: np.ndarray, sizes: list[int]) -> np.ndarray:
    return np.concatenate([W.runs(tokens, size, seed=100 + size) for size in sizes]) if len(tokens) else np.zeros(0, dtype=np.uint64)


def candidates(docs: DataFrame, items: DataFrame, min_match: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, item_id, tokens`` of all pairs that share a seed; ``items`` is settled.

    The benchmark's seeds are counted first. While they are few (``SHIPPED_SEEDS``) each task filters its documents
    against them and only documents with a hit leave it; else document seeds are joined by a shuffle, and their
    keys back to all rows. The pairs are the same, one for each of several equal rows.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seeds = items.select(F.explode("seeds").alias("seed"), "size", "item_key")
    count, sizes = seeds.agg(F.count(F.lit(1)), F.collect_set("size")).first()
    sizes = sorted(sizes)
    shipped = None
    if count <= SHIPPED_SEEDS:
        table = seeds.select("seed", "item_key").toArrow()
        values = table.column("seed").to_numpy().view(np.uint64)
        order = np.argsort(values, kind="stable")
        shipped = spark.sparkContext.broadcast((values[order], table.column("item_key").to_numpy()[order]))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys = shipped.value
        for whole in batches:
            for batch in W.slices(whole, "text"):
                tokens, first = token_hashes(batch.column(1))
                touched = np.zeros(len(tokens), dtype=bool)
                for size in sizes:
                    grams = W.runs(tokens, size, seed=100 + size)
                    if len(grams) and len(known):
                        spot = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                        touched[np.flatnonzero(known[spot] == grams)] = True
                rows, found = [], []
                for row in np.unique(np.searchsorted(first, np.flatnonzero(touched), side="right") - 1):
                    own = np.unique(_doc_seeds(tokens[first[row] : first[row + 1]], sizes))
                    left, right = np.searchsorted(known, own), np.searchsorted(known, own, side="right")
                    met = sorted({int(k) for a, b in zip(left, right) for k in keys[a:b]})
                    if met:
                        rows.append(row)
                        found.append(met)
                if rows:
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text", "item_keys"])

    def all_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                tokens, first = token_hashes(batch.column(1))
                own = [np.unique(_doc_seeds(tokens[first[i] : first[i + 1]], sizes)).view(np.int64) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "own"])

    if shipped is not None:
        pairs = read.mapInArrow(hits, "doc_id long, text string, item_keys array<long>").select("doc_id", "text", F.explode("item_keys").alias("item_key"))
    else:
        keyed = read.withColumn("text_hash", F.xxhash64("text"))
        own = keyed.mapInArrow(all_seeds, "doc_id long, text_hash long, own array<long>").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.explode("own").alias("seed"))
        met = own.join(seeds, "seed").groupBy("d", "h").agg(F.collect_set("item_key").alias("item_keys"))
        pairs = keyed.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text", F.explode("item_keys").alias("item_key"))
    return pairs.join(items.select("item_key", "item_id", "tokens"), "item_key").select("doc_id", "text", "item_id", "tokens", F.xxhash64("text").alias("text_hash"))


def tiled(pairs: DataFrame, min_match: int) -> DataFrame:
    """Tile every pair: ``doc_id, text_hash, item_id, n_tokens, n_covered, n_tiles, covered``."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int32()), ("n_covered", pa.int32()), ("n_tiles", pa.int32()), ("covered", pa.float64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                tokens, first = token_hashes(batch.column(1))
                out = []
                for row, (doc_id, item_id, packed, text_hash) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)))):
                    item = np.frombuffer(packed, dtype=np.uint64)
                    marked = tiles(item, tokens[first[row] : first[row + 1]], min_match)
                    covered = sum(length for _, _, length in marked)
                    out.append((doc_id, text_hash, item_id, len(item), covered, len(marked), covered / len(item)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return pairs.mapInArrow(compute, RESULT)


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row per (document, item) whose tiles cover enough of the item."""
    keyed = settle(item_seeds(items, min_match, item_col, text_col).withColumn("item_key", F.xxhash64("item_id", "tokens")).dropDuplicates(["item_key"]), "benchmark")
    pairs = candidates(docs, keyed, min_match, id_col, text_col)
    spread = pairs.repartition(F.xxhash64("doc_id", "item_id"))
    return tiled(spread, min_match).filter(F.col("covered") >= coverage)


def clean(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    found = contaminated(docs, items, min_match, coverage)
    doc, text_hash = free_names(docs, "leaked_id", "leaked_hash")
    leaked = settle(found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)).distinct(), "leaked")
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), "left_anti")
