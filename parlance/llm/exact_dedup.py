"""Exact dedup: a cuckoo-filter index over live digests, verified against bucketed content.

The index is dealt into parts by digest. A part holds a cuckoo filter of short fingerprints and, per
filter bucket, the full digests stored there with the row that stays and the number of live rows. A
filter hit counts only after the full digest was found in the bucket; a full filter is built anew, twice
as wide, from the stored digests.

Cases: a null text counts as the empty text; a null id is lower than every other id; equal rows with
equal id are all live and, if their id is the largest, all kept; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 4
KICKS = 200
#: Rows whose copies are summed before they travel.
TOGETHER = 100_000
ENTRY = "part int, digest binary, keep_id long, live long"


class CuckooFilter:
    """Set of 64-bit hashes with deletion; answers "absent" or "maybe present"."""

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * 9 < capacity * 10:  # at most 90 % full
            buckets *= 2
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * buckets * SLOTS))
        self.turn = 0

    @staticmethod
    def _mark(value: int) -> int:
        return (value >> 48) % 65535 + 1  # 0 is an empty slot

    def home(self, value: int) -> int:
        return value & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _put(self, bucket: int, mark: int) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[at]:
                self.slots[at] = mark
                return True
        return False

    def contains(self, value: int) -> bool:
        mark, first = self._mark(value), self.home(value)
        second = self._other(first, mark)
        slots = self.slots
        return mark in slots[first * SLOTS : first * SLOTS + SLOTS] or mark in slots[second * SLOTS : second * SLOTS + SLOTS]

    def insert(self, value: int) -> bool:
        """False where no slot was found: the caller builds a wider filter from its stored keys."""
        mark, bucket = self._mark(value), self.home(value)
        if self._put(bucket, mark):
            return True
        bucket = self._other(bucket, mark)
        for _ in range(KICKS):
            if self._put(bucket, mark):
                return True
            self.turn = (self.turn + 1) % SLOTS
            at = bucket * SLOTS + self.turn
            mark, self.slots[at] = self.slots[at], mark
            bucket = self._other(bucket, mark)
        return False

    def delete(self, value: int) -> bool:
        mark, first = self._mark(value), self.home(value)
        for bucket in (first, self._other(first, mark)):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[at] == mark:
                    self.slots[at] = 0
                    return True
        return False


class DigestPart:
    """One part of the index: the filter and the content of its buckets."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.content: dict[int, dict[bytes, list]] = {}
        self.resized = 0

    @staticmethod
    def _value(digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "little")

    def find(self, digest: bytes) -> list | None:
        """The entry of a live digest: the filter is asked first, a hit is verified against the bucket's content."""
        value = self._value(digest)
        if not self.filter.contains(value):
            return None
        return self.content.get(self.filter.home(value), {}).get(digest)

    def _store(self, digest: bytes, entry: list) -> None:
        value = self._value(digest)
        self.content.setdefault(self.filter.home(value), {})[digest] = entry
        if not self.filter.insert(value):
            self._resize()

    def _resize(self) -> None:
        stored = [x for bucket in self.content.values() for x in bucket.items()]
        width = (self.filter.mask + 1) * SLOTS
        while True:
            width *= 2
            self.filter = CuckooFilter(width)
            self.resized += 1
            if all(self.filter.insert(self._value(digest)) for digest, _ in stored):
                break
        self.content = {}
        for digest, entry in stored:
            self.content.setdefault(self.filter.home(self._value(digest)), {})[digest] = entry

    def add(self, digest: bytes, keep_id: int | None, live: int) -> None:
        entry = self.find(digest)
        if entry is None:
            self._store(digest, [keep_id, live])
        else:
            if entry[0] is None or (keep_id is not None and keep_id > entry[0]):
                entry[0] = keep_id
            entry[1] += live

    def remove(self, digest: bytes) -> bool:
        """Take a digest out, whatever its number of rows; False where it isn't live."""
        if self.find(digest) is None:
            return False
        value = self._value(digest)
        home = self.filter.home(value)
        del self.content[home][digest]
        if not self.content[home]:
            del self.content[home]
        return self.filter.delete(value)

    def entries(self) -> Iterator[tuple[bytes, int | None, int]]:
        for bucket in self.content.values():
            for digest, (keep_id, live) in bucket.items():
                yield digest, keep_id, live


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256`` of every row."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
    )


def updated_index(entries: DataFrame | None, inserts: DataFrame | None, deletes: DataFrame | None = None, parts: int = 64) -> DataFrame:
    """Apply changes to an index: deletions of stored digests first, then insertions.

    ``entries`` is an earlier result (None: a new index), ``inserts`` has ``digest binary, keep_id, live``,
    ``deletes`` has ``digest``. Returns the live entries, ``part, digest, keep_id, live``. ``parts`` bounds
    what one task holds: choose it so that a part has at most a million digests or so.
    """
    steps = []
    for order, frame in ((0, entries), (1, deletes), (2, inserts)):
        if frame is None:
            continue
        keep = F.col("keep_id").cast("long") if order != 1 else F.lit(None).cast("long")
        live = F.col("live").cast("long") if order != 1 else F.lit(0).cast("long")
        steps.append(frame.select("digest", keep.alias("keep_id"), live.alias("live"), F.lit(order).alias("step")))
    if not steps:
        raise ValueError("nothing to index")
    rows = steps[0]
    for more in steps[1:]:
        rows = rows.unionAll(more)
    part = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(parts)).cast("int")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index = None, DigestPart()
        schema = pa.schema([("part", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("live", pa.int64())])

        def flushed() -> Iterator[pa.RecordBatch]:
            out = list(index.entries())
            for at in range(0, len(out), 10_000):
                piece = out[at : at + 10_000]
                columns = list(zip(*piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([current] * len(piece), pa.int32()), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                    schema=schema,
                )

        for batch in batches:
            for number, digest, keep_id, live, step in zip(*(column.to_pylist() for column in batch.columns)):
                if number != current:
                    if current is not None:
                        yield from flushed()
                    current, index = number, DigestPart()
                if step == 1:
                    index.remove(digest)
                else:
                    index.add(digest, keep_id, live)
        if current is not None:
            yield from flushed()

    dealt = rows.select(part.alias("part"), "digest", "keep_id", "live", "step").repartition(parts, "part")
    return dealt.sortWithinPartitions("part", "step").mapInArrow(apply, ENTRY)


def live_entries(hashed: DataFrame, parts: int = 64) -> DataFrame:
    """A new index over ``doc_id, text_sha256`` rows.

    Copies are summed within a task, ``TOGETHER`` rows at a time, before they travel: of a text that a third of all rows share
    the index gets a row per so many rows. It inserts the first and merges the others, each hit verified.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def merged() -> Iterator[pa.RecordBatch]:
            if held:
                sums = pa.Table.from_batches(held).group_by("digest").aggregate([("doc_id", "max"), ([], "count_all")])
                yield from sums.select(["digest", "doc_id_max", "count_all"]).rename_columns(["digest", "keep_id", "live"]).to_batches()
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                yield from merged()
        yield from merged()

    rows = hashed.select(F.unhex("text_sha256").alias("digest"), "doc_id").mapInArrow(summed, "digest binary, keep_id long, live long")
    return updated_index(None, rows, parts=parts)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row; the largest id of equal texts stays."""
    spark = docs.sparkSession
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // 500_000))
    hashed = digests(docs, id_col, text_col)
    index = live_entries(hashed, parts).select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", F.col("live").alias("group_size"))
    return hashed.join(index, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
