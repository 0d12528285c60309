"""MinHash near-dedup: universal hash minima, banding, verification, components by large-star and small-star.

1. Every document's set of word shingles is hashed; equal sets become one node.
2. 128 multiply-shift hash functions give each set its minima, 16 bits of each are the signature. Bands of
   four minima are the bucket keys: two sets of similarity 0.8 share none of the 32 with a chance of 5e-8.
3. Each bucket ties its members to its smallest node. A pair whose signatures agree in fewer than 60 % of the
   minima is dropped (at similarity 0.8 that takes 5.8 standard deviations), the others are confirmed on full sets.
4. Components. Where a bucket still holds several, block by block the nodes that may be linked across components are
   tied together, by size and signature; each tied group's texts are then compared once, and a pair is confirmed
   only while its components are not yet joined. Pairs never leave a task, and pairs inside a component are never
   looked at, so a large group of near copies costs about one comparison per member.

Cases: a null or blank text has an empty set, is linked with nothing and is its own component; a text shorter
than a shingle is one shingle; rows with equal ids share their component ids but are compared by their own texts; a
null id is never a component's smallest id unless it has no other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import words as W
from parlance.llm.components import connected_components
from parlance.session import settle

HASHES, BAND_ROWS = 128, 4
BANDS = HASHES // BAND_ROWS
AGREEING = 77  # of 128
#: Signatures and texts on one side of a comparison cell, and pairs of one node that are confirmed in one group.
BLOCK, TEXT_BLOCK, GROUP = 1024, 256, 500
#: Shingles on one side of a cell of texts (a longer text is a side of its own, by chance beside others).
SHINGLE_BLOCK = 1 << 17

FEATURES = "doc_id long, text_hash long, n_shingles long, node binary, signature binary"
FEATURES_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("signature", pa.binary())])


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row, lower-casing A-Z."""
    found = W.words_of(column, lower=True)
    grams = W.runs(found.hash, width, seed=7)
    for row in range(len(column)):
        span = found.of(row)
        count = span.stop - span.start
        if count >= width:
            yield np.unique(grams[span.start : span.stop - width + 1])
        elif count:
            yield W.runs(found.hash[span], count, seed=7 + count)
        else:
            yield np.zeros(0, dtype=np.uint64)


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two full sets reach the similarity."""
    spot = np.searchsorted(one, other)
    common = int((one[np.minimum(spot, len(one) - 1)] == other).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of every set under each hash function; rows of empty sets are zero."""
    out = np.zeros((len(sets), HASHES), dtype=np.uint16)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return out
    flat = np.concatenate([sets[i] for i in filled])
    first = np.cumsum([0] + [len(sets[i]) for i in filled[:-1]])
    factor, shift = W.odd_constants(HASHES, 11), W.odd_constants(HASHES, 13)
    hashed = np.empty_like(flat)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            np.multiply(flat, factor[k], out=hashed)
            hashed += shift[k]
            least = np.minimum.reduceat(hashed, first)
            out[filled, k] = (W.mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def features(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text", 1 << 19):
                sets = list(shingle_sets(batch.column(2), width))
                signed = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([row.tobytes() for row in signed], pa.binary()),
                    ],
                    schema=FEATURES_ARROW,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, FEATURES)


def bucket_rows(sets: DataFrame) -> DataFrame:
    """``key, node, leader`` of the buckets with several members; the leader is the smallest of them."""
    size = 2 * BAND_ROWS
    bands = [F.xxhash64(F.lit(b), F.substring("signature", b * size + 1, size)) for b in range(BANDS)]
    keys = sets.select("node", F.explode(F.array(*bands)).alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("members"))
    return keys.join(leaders.filter("members > 1"), "key").select("key", "node", "leader")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, HASHES) for i in (2, 3))
        good = pa.array((left == right).sum(axis=1) >= AGREEING)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes allow the similarity and whose signatures agree enough."""
    one = sets.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("signature_a"))
    other = sets.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("signature_b"))
    met = pairs.join(one, "a").join(other, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    met = met.select("a", "b", "signature_a", "signature_b")
    return met.mapInArrow(_agreeing, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links ``u, v``: pairs ``a, b`` whose full sets meet the threshold.

    Texts travel to the pairs: one is sent to each group of up to ``GROUP`` pairs of an ``a``, so a node with many pairs is
    dealt to many tasks and a task holds one set at a time.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).withColumn("groups", F.ceil(F.col("pairs") / F.lit(GROUP)).cast("int"))
    dealt = pairs.join(counts.select("a", "groups"), "a").select("b", F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("group"))
    hubs = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    wanted = dealt.select(F.col("b").alias("node"), "hub", "group", F.lit(1).alias("side")).unionAll(
        hubs.select(F.col("a").alias("node"), F.col("a").alias("hub"), "group", F.lit(0).alias("side"))
    )
    wanted = wanted.join(sets.select("node", "rep"), "node")
    targets = wanted.groupBy("rep.doc_id", "rep.text_hash").agg(F.collect_list(F.struct("hub", "group", "side", "node")).alias("targets"))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    sent = rows.join(targets, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash")))
    sent = sent.select("text", F.inline("targets")).select("hub", "group", "side", "node", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub_set = None, None
        for whole in batches:
            for batch in W.slices(whole, "text", 1 << 19):
                out = []
                hubs, groups, sides, nodes = (batch.column(i).to_pylist() for i in range(4))
                for hub, group, side, node, found in zip(hubs, groups, sides, nodes, shingle_sets(batch.column(4), width)):
                    if side == 0:
                        at, hub_set = (hub, group), found
                    elif at == (hub, group):
                        if _linked(hub_set, found, percent):
                            out.append((node, hub))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["u", "v"])

    return sent.repartition("hub", "group").sortWithinPartitions("hub", "group", "side").mapInArrow(check, "u binary, v binary")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.select(F.col("node").alias("known"), "root")
    return rows.join(known, F.col("node") == F.col("known"), "left").drop("known").withColumn("root", F.coalesce("root", "node"))


def _cells(rows: DataFrame, key: str, block: int, weight_block: int | None = None) -> DataFrame:
    """Deal rows ``key, node, root`` of mixed groups into comparison cells ``key, x, y``.

    A group's most frequent root is its main one. Rows of other roots are cut into blocks x; each meets every block y >= 0 of
    the main root's rows and every other block (y < 0: block -y-1). Rows of the main root never meet each other, so a
    group that is one component but for a few rows costs a copy or so per row. Where rows have a ``weight``, blocks are as many
    as keep theirs at ``weight_block`` too.
    """
    parts = rows.groupBy(key, "root").agg((F.count(F.lit(1)) if weight_block is None else F.greatest(F.count(F.lit(1)), F.ceil(F.sum("weight") / F.lit(weight_block / block)))).alias("n"))
    groups = parts.groupBy(key).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("main_rows"), F.sum("n").alias("all_rows"))
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    groups = groups.filter("all_rows > main_rows").select(key, "main", blocks(F.col("main_rows")).alias("mains"), blocks(F.col("all_rows") - F.col("main_rows")).alias("others"))
    mixed = rows.join(groups, key).withColumn("other", F.col("root") != F.col("main"))
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    mine_main, mine_other = at(F.col("mains")), at(F.col("others"))
    of_main = F.transform(every(F.col("others")), lambda x: cell(x, mine_main))
    to_main = F.transform(every(F.col("mains")), lambda y: cell(mine_other, y))
    to_other = F.transform(every(F.col("others")), lambda z: cell(F.least(z, mine_other), -F.greatest(z, mine_other) - 1))
    dealt = F.when(F.col("other"), F.concat(to_main, to_other)).otherwise(of_main)
    return mixed.select(key, "node", "root", "other", F.inline(dealt))


class _Cell:
    """The rows of one cell: which of them may still be linked, and what has been joined in it."""

    def __init__(self, nodes: list[bytes], roots: list[bytes], others: list[bool], sizes: np.ndarray, signed: np.ndarray, percent: int):
        self.nodes, self.sizes, self.signed, self.percent = nodes, sizes, signed, percent
        self.others = [i for i, other in enumerate(others) if other]
        number = {root: i for i, root in enumerate(dict.fromkeys(roots))}
        self.root = np.array([number[r] for r in roots])

    def near(self, i: int) -> np.ndarray:
        """Rows of other roots whose sizes and signatures allow a link with row i."""
        fits = 100 * np.minimum(self.sizes, self.sizes[i]) >= self.percent * np.maximum(self.sizes, self.sizes[i])
        rows = np.flatnonzero(fits & (self.root != self.root[i]))
        return rows[(self.signed[rows] == self.signed[i]).sum(axis=1) >= AGREEING]


def _by_cell(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of the rows of one cell after another; the cell is the first ``keys`` columns."""
    cell, held = None, []
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:keys] != cell:
                if held:
                    yield list(zip(*held))
                cell, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield list(zip(*held))


def possible_links(buckets: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Ties ``u, v`` that connect all nodes which may be linked across components, by sizes and signatures.

    Not the pairs: of each cell only a tie from every such node to one that stands for those it may be linked with.
    """
    rooted = _rooted(buckets.select("key", "node"), roots)
    cells = _cells(rooted, "key", BLOCK).join(sets.select("node", "n_shingles", "signature"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, known, others, sizes, signed in _by_cell(batches, 3):
            cell = _Cell(nodes, known, others, np.array(sizes), np.frombuffer(b"".join(signed), dtype=np.uint16).reshape(-1, HASHES), percent)
            top = np.arange(len(nodes))  # the node that each one is tied to
            for i in cell.others:
                near = cell.near(i)
                if len(near):
                    met = np.unique(top[np.append(near, i)])
                    top[np.isin(top, met)] = met[0]
            tied = np.flatnonzero(top != np.arange(len(nodes)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in tied], pa.binary()), pa.array([nodes[top[i]] for i in tied], pa.binary())], names=["u", "v"])

    rows = cells.select("key", "x", "y", "node", "root", "other", "n_shingles", "signature")
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node").mapInArrow(compare, "u binary, v binary").distinct()


def links_across(ties: DataFrame, roots: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links ``u, v`` across components among tied nodes, confirmed on full sets.

    Each tied group's texts are dealt to cells, where all pairs across components that sizes and signatures allow are confirmed
    until their components are joined. Only joining links leave a cell.
    """
    grouped = connected_components(ties).select("node", F.col("root").alias("team"))
    weighed = grouped.join(sets.select("node", F.col("n_shingles").alias("weight")), "node")
    cells = _cells(_rooted(weighed, roots), "team", TEXT_BLOCK, SHINGLE_BLOCK).join(sets.select("node", "rep"), "node")
    wanted = cells.groupBy("rep.doc_id", "rep.text_hash").agg(F.collect_list(F.struct("team", "x", "y", "node", "root", "other")).alias("targets"))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    sent = rows.join(wanted, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash")))
    sent = sent.dropDuplicates(["row_id", "row_hash"]).select("text", F.inline("targets")).select("team", "x", "y", "node", "root", "other", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, known, others, texts in _by_cell(batches, 3):
            column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
            sets = [s for piece in W.slices(column, "text", 1 << 19) for s in shingle_sets(piece.column(0), width)]
            cell = _Cell(nodes, known, others, np.array([len(s) for s in sets]), signatures(sets), percent)
            out = []
            for i in cell.others:
                for j in cell.near(i):
                    if cell.root[i] != cell.root[j] and _linked(sets[i], sets[j], percent):
                        out.append((nodes[i], nodes[j]))
                        cell.root[cell.root == cell.root[i]] = cell.root[j]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["u", "v"])

    return sent.repartition("team", "x", "y").sortWithinPartitions("team", "x", "y", "node").mapInArrow(check, "u binary, v binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` for every row; ``percent`` is at least 80."""
    return components_of(docs, width, percent, id_col, text_col).drop("component")


def components_of(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash, component`` for every row; ``percent`` is at least 80.

    ``component`` names the component whatever its ids are; it is null for an empty set.
    """
    if percent < 80:
        raise ValueError("bands and signatures are laid out for similarities of 0.8 and more")
    rows = settle(features(docs, width, id_col, text_col), "shingles")
    rep = F.struct("doc_id", "text_hash")
    filled = rows.filter("n_shingles > 0").groupBy("node").agg(F.min(rep).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    sets = settle(filled, "shingle-sets")
    buckets = settle(bucket_rows(sets), "buckets")
    again = (width, percent, id_col, text_col)

    stars = buckets.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = settle(alike(stars, sets, percent), "pairs")
    links = settle(confirmed(pairs, sets, docs, *again), "confirmed")
    roots = settle(connected_components(links), "roots")
    ties = settle(possible_links(buckets, roots, sets, percent), "ties")
    more = settle(links_across(ties, roots, sets, docs, *again), "confirmed")
    roots = settle(connected_components(links.unionByName(more)), "roots")

    found = _rooted(rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "node", "text_hash"), roots)
    lowest = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = found.join(lowest, "root").select("doc_id", "n_shingles", "component_id", "text_hash", F.col("root").alias("component"))
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("binary").alias("component"))
    out = linked.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "component")
