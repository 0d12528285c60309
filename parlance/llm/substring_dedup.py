"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of a document. Its minimiser is the least hash among its runs of ``RUN`` words;
neighbouring windows with the same minimiser form a super-k-mer and travel as one string to the minimiser's
bucket, where the windows are sorted and the lowest document of each is found. A window is removed, with all
its words, where a lower document holds it too.

Documents are dealt into blocks of bounded text. Three passes over the blocks share one shuffle of the texts:

1. Each block lists its minimisers. One that only a single document has cannot belong to a shared window,
   so its super-k-mers need not travel; one with very many super-k-mers is marked hot.
2. Each block sends the super-k-mers of its remaining minimisers. Windows with a hot minimiser travel one by one,
   once per block, to a bucket of their own, so a passage that a third of all documents holds gives
   a row per block and no bucket gets all its surroundings.
3. Buckets answer with the windows to remove; each block marks and cuts its texts.

Cases: a null text has no words; a document shorter than a window keeps all; a null id counts as larger than every
other id, and equal ids as one document, whose own repeats stay; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import words as W

#: Words of a minimiser run.
RUN = 4
#: Windows that one packed string may hold, so that a reply's marks fit a long.
SPAN = 32
#: Super-k-mers of one minimiser that one task gathers; beyond it the minimiser is hot.
HOT = 4_000
#: Characters of a block.
BLOCK_CHARS = 6_000_000
LAST = np.iinfo(np.int64).max
FIRST_SEED, SECOND_SEED = 0, 977


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Block:
    """The documents of a block in a fixed order, their word hashes and windows."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        table = table.select(["doc_id", "text_hash", "text"]).combine_chunks()
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text_hash", "ascending")])
        table = table.take(order)
        ids = table.column("doc_id")
        self.known_ids = ids.to_pylist()
        self.ids = ids.fill_null(int(LAST)).to_numpy().astype(np.int64)
        column = table.column("text").cast(pa.large_string()).combine_chunks()
        self.texts = column if isinstance(column, pa.LargeStringArray) else column.chunk(0)
        self.hash, self.first = self._hashes(FIRST_SEED)
        count = len(self.hash) - width + 1
        self.doc_of = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.valid = np.zeros(len(self.hash), dtype=bool)
        if count > 0:
            self.valid[:count] = self.doc_of[:count] == self.doc_of[width - 1 :]
            least = sliding_least(W.runs(self.hash, RUN, seed=5), width - RUN + 1)
            self.least = np.zeros(len(self.hash), dtype=np.uint64)
            self.least[:count] = least[:count]
        else:
            self.least = np.zeros(len(self.hash), dtype=np.uint64)

    def _hashes(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        parts, first, total = [], [np.zeros(1, dtype=np.int64)], 0
        batch = pa.RecordBatch.from_arrays([self.texts], names=["text"])
        for piece in W.slices(batch, "text"):
            found = W.words_of(piece.column(0), seed=seed)
            parts.append(found.hash)
            first.append(found.first[1:] + total)
            total += len(found.hash)
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), np.concatenate(first)

    def words(self, doc: int) -> list[bytes]:
        text = self.texts[doc].as_py()
        return text.encode().split() if text else []

    def super_kmers(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first window and number of windows of each super-k-mer."""
        at = np.flatnonzero(self.valid)
        if not len(at):
            return at, at
        starts = np.ones(len(at), dtype=bool)
        starts[1:] = (np.diff(at) != 1) | (self.least[at[1:]] != self.least[at[:-1]]) | (self.doc_of[at[1:]] != self.doc_of[at[:-1]])
        begin = np.flatnonzero(starts)
        size = np.diff(np.concatenate([begin, [len(at)]]))
        pieces = -(-size // SPAN)  # a long run of one repeated phrase is cut
        inner = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        place = np.repeat(at[begin], pieces) + inner * SPAN
        return place, np.minimum(np.repeat(size, pieces) - inner * SPAN, SPAN)


def _minimisers(width: int):
    schema = pa.schema([("least", pa.int64()), ("block", pa.int32()), ("count", pa.int32()), ("docs", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        block = Block(table, width)
        place, _ = block.super_kmers()
        value, doc = block.least[place], block.ids[block.doc_of[place]]
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = value[1:] != value[:-1]
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate([begin, [len(value)]]))
        several = (doc[begin] != doc[begin + count - 1]) if len(begin) else np.zeros(0, dtype=bool)
        number = table.column("block")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array(value[begin].view(np.int64)), pa.array(np.full(len(begin), number), pa.int32()), pa.array(count, pa.int32()), pa.array(1 + several, pa.int32())],
            schema=schema,
        )

    return run


def _shared_minimisers(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimiser in, ``block, least, hot`` of those in several documents out.

    Only the unfinished minimiser at a batch's end is carried on, and no more once it is known to be hot.
    """

    def rows(least: np.ndarray, block: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(least, pa.int64()), pa.array(hot, pa.bool_())], names=["block", "least", "hot"])

    held, known_hot = None, None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now)]
        least, block, count, docs = now
        if known_hot is not None:
            lead = int(np.searchsorted(least, known_hot, side="right"))
            if lead:
                yield rows(least[:lead], block[:lead], np.ones(lead, dtype=bool))
                least, block, count, docs = (x[lead:] for x in (least, block, count, docs))
            if len(least):
                known_hot = None
        if not len(least):
            held = None
            continue
        last = int(np.searchsorted(least, least[-1], side="left"))
        yield from _judged(most, rows, least[:last], block[:last], count[:last], docs[:last])
        held = [x[last:] for x in (least, block, count, docs)]
        if held[2].sum() > most:
            known_hot = held[0][0]
            yield rows(held[0], held[1], np.ones(len(held[0]), dtype=bool))
            held = None
    if held is not None:
        yield from _judged(most, rows, *held)


def _judged(most, rows, least, block, count, docs) -> Iterator[pa.RecordBatch]:
    if len(least):
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        size = np.diff(np.concatenate([begin, [len(least)]]))
        shared = np.repeat(np.add.reduceat(docs, begin) > 1, size)
        hot = np.repeat(np.add.reduceat(count.astype(np.int64), begin) > most, size)
        yield rows(least[shared], block[shared], hot[shared])


SENT = "route long, low long, hot boolean, block int, place long, packed binary"


def _sent(width: int):
    schema = pa.schema([("route", pa.int64()), ("low", pa.int64()), ("hot", pa.bool_()), ("block", pa.int32()), ("place", pa.int64()), ("packed", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        block = Block(left, width)
        number = left.column("block")[0].as_py()
        live = right.column("least").to_numpy().view(np.uint64)
        order = np.argsort(live)
        live, live_hot = live[order], right.column("hot").to_numpy(zero_copy_only=False).astype(bool)[order]
        place, size = block.super_kmers()
        spot = np.minimum(np.searchsorted(live, block.least[place]), len(live) - 1)
        go = live[spot] == block.least[place]
        place, size, hot = place[go], size[go], live_hot[spot[go]]
        grams = W.runs(block.hash, width, seed=9)
        routes, lows, kinds, places, packs = [], [], [], [], []
        seen: dict[bytes, int] = {}
        doc, words = -1, []
        for at, count, is_hot, at_doc in zip(place.tolist(), size.tolist(), hot.tolist(), block.doc_of[place].tolist()):
            if at_doc != doc:
                doc, words = at_doc, block.words(at_doc)
            inside = at - int(block.first[doc])
            if is_hot:
                for i in range(count):
                    text = b" ".join(words[inside + i : inside + i + width])
                    if text not in seen:  # ids ascend, so the first one is the block's lowest
                        seen[text] = at + i
                        routes.append(int(grams[at + i].view(np.int64)))
                        lows.append(int(block.ids[doc]))
                        kinds.append(True)
                        places.append(at + i)
                        packs.append(text)
            else:
                routes.append(int(block.least[at].view(np.int64)))
                lows.append(int(block.ids[doc]))
                kinds.append(False)
                places.append(at)
                packs.append(b" ".join(words[inside : inside + count + width - 1]))
        return pa.Table.from_arrays(
            [pa.array(routes, pa.int64()), pa.array(lows, pa.int64()), pa.array(kinds, pa.bool_()), pa.array([number] * len(routes), pa.int32()), pa.array(places, pa.int64()), pa.array(packs, pa.binary())],
            schema=schema,
        )

    return run


ANSWERS = "block int, place long, marks long, first long"
ANSWERS_ARROW = pa.schema([("block", pa.int32()), ("place", pa.int64()), ("marks", pa.int64()), ("first", pa.int64())])


def _answers(width: int):
    """Rows sorted by (hot, route, low) in; out the windows to remove (``marks``) and hot windows' lowest document (``first``)."""

    def cold(table: pa.Table) -> Iterator[pa.RecordBatch]:
        packed = pa.concat_arrays([c.view(pa.string()) if c.type == pa.binary() else c for c in table.column("packed").chunks])
        low = table.column("low").to_numpy()
        one, other = W.words_of(packed, seed=FIRST_SEED), W.words_of(packed, seed=SECOND_SEED)
        windows = np.diff(one.first) - width + 1
        entry = np.repeat(np.arange(len(low)), windows)
        inner = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = one.first[entry] + inner
        h1, h2 = W.runs(one.hash, width, seed=9)[start], W.runs(other.hash, width, seed=10)[start]
        order = np.lexsort((low[entry], h2, h1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        begin = np.flatnonzero(new)
        lowest = np.repeat(low[entry][order[begin]], np.diff(np.concatenate([begin, [len(order)]])))
        gone = order[lowest < low[entry[order]]]
        if len(gone):
            marks = np.zeros(len(low), dtype=np.int64)
            np.bitwise_or.at(marks, entry[gone], np.int64(1) << inner[gone])
            hit = np.flatnonzero(marks)
            take = pa.array(hit)
            blocks, places = table.column("block").combine_chunks().take(take), table.column("place").combine_chunks().take(take)
            yield from pa.Table.from_arrays([blocks, places, pa.array(marks[hit]), pa.nulls(len(hit), pa.int64())], schema=ANSWERS_ARROW).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        hot_route, firsts = None, {}
        for batch in batches:
            split = int(np.searchsorted(batch.column(2).to_numpy(zero_copy_only=False), True))
            route = batch.column(0).to_numpy()
            if split:
                ready = batch.slice(0, split)
                last = int(np.searchsorted(route[:split], route[split - 1]))
                if last or (held and held[-1].column(0)[-1].as_py() != route[0]):
                    whole = held + [ready.slice(0, last)]
                    yield from cold(pa.Table.from_batches([b for b in whole if b.num_rows]))
                    held = []
                held.append(ready.slice(last))
            if split < batch.num_rows and held:
                yield from cold(pa.Table.from_batches(held))
                held = []
            out = []
            for key, low, _, block, place, text in zip(*(c.to_pylist() for c in batch.slice(split).columns)):
                if key != hot_route:
                    hot_route, firsts = key, {}
                out.append((block, place, None, firsts.setdefault(text, low)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ANSWERS_ARROW)], schema=ANSWERS_ARROW)
        if held:
            yield from cold(pa.Table.from_batches(held))

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def _cut(width: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        block = Block(left, width)
        gone = np.zeros(len(block.hash) + 1, dtype=np.int64)  # differences: windows to remove begin and end
        if right.num_rows:
            place = right.column("place").to_numpy()
            marks = right.column("marks").fill_null(0).to_numpy()
            windows = [place[(marks >> i & 1) == 1] + i for i in range(SPAN)]
            hot = np.array(right.column("marks").is_null())
            if hot.any():
                windows.append(_hot_places(block, place[hot], right.column("first").to_numpy(zero_copy_only=False)[hot].astype(np.int64)))
            windows = np.concatenate(windows)
            np.add.at(gone, windows, 1)
            np.add.at(gone, windows + width, -1)
        removed = np.cumsum(gone[:-1]) > 0
        counts, texts, digests = [], [], []
        for doc in range(len(block.ids)):
            words = block.words(doc)
            cut = removed[block.first[doc] : block.first[doc + 1]]
            lost = int(cut.sum())
            kept = b" ".join(compress(words, (~cut).tolist()) if lost else words)
            counts.append(lost)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode())
        sizes = np.diff(block.first)
        text_column = pa.array(texts, pa.string()) if with_text else pa.nulls(len(sizes), pa.string())
        return pa.Table.from_arrays([pa.array(block.known_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), text_column, pa.array(digests, pa.string())], schema=schema)

    return run


def _hot_places(block: Block, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All windows of the block equal to those at ``place`` in documents above ``first``."""
    second, _ = block._hashes(SECOND_SEED)
    h1, h2 = W.runs(block.hash, block.width, seed=9), W.runs(second, block.width, seed=10)
    order = np.argsort(h1[place], kind="stable")
    place, first = place[order], first[order]
    at = np.flatnonzero(block.valid[: len(h1)])
    spot = np.minimum(np.searchsorted(h1[place], h1[at]), len(place) - 1)
    same = (h1[place[spot]] == h1[at]) & (h2[place[spot]] == h2[at])
    return at[same & (block.ids[block.doc_of[at]] > first[spot])]


def without_shared_windows(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256`` of every row.

    ``hot`` bounds the super-k-mers of one minimiser that a task gathers; the result doesn't depend on it.
    """
    size = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_CHARS))
    text_hash = F.xxhash64(text_col)
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), text_hash), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).cast("long").alias("doc_id"),
        text_hash.alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    texts = rows.repartition(blocks, "block")  # one shuffle, which all three passes read
    listed = texts.groupBy("block").applyInArrow(_minimisers(width), "least long, block int, count int, docs int")
    shared = listed.repartition("least").sortWithinPartitions("least").mapInArrow(partial(_shared_minimisers, hot), "block int, least long, hot boolean")
    sent = texts.groupBy("block").cogroup(shared.repartition(blocks, "block").groupBy("block")).applyInArrow(_sent(width), SENT)
    answers = sent.repartition("route").sortWithinPartitions("hot", "route", "low").mapInArrow(_answers(width), ANSWERS)
    return texts.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block")).applyInArrow(_cut(width, with_text), RESULT)
