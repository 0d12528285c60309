"""Token-id files with constant-time keyed access.

``write_shards`` deals documents by ascending id into shards and writes each shard's ids as raw
little-endian unsigned integers (two bytes where the vocabulary allows it, else four), documents one after
another, each closed by an end id. ``write_index`` builds a minimal perfect hash over the document keys, split
into index files by key hash: every key of a file gets its own slot, which stores the key's fingerprint and its
shard, first id and length. ``read_tokens`` resolves keys through the index and reads the ids back.

Files are written under a temporary name and renamed when whole; a repeated task writes the same bytes
again. Paths may be any that PyArrow's file systems open (local, HDFS, object stores).

Cases: a null text is the empty text (it holds the end id only); rows with equal id are all written, next
to each other, and told apart by their ``copy`` number; a null id is a key of its own and comes first; an
empty table gives no file; other columns are not read.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.words import GOLDEN, MASK64, _hashes, mix, text_bytes
from parlance.session import settle, shared_path

#: Distinct words whose ids a task remembers, some 50 bytes each; beyond it, it forgets them all and starts again.
REMEMBERED = 1_000_000
GAMMA = 2.0
LEVELS = 24
MANIFEST = "doc_id long, shard int, place long, offset long, n_tokens long, copy_in_shard long"
MANIFEST_ARROW = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("copy_in_shard", pa.int64())])


# ---------------------------------------------------------------- files


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _shard_name(folder: str, shard: int) -> str:
    return f"{folder}/tokens-{shard:06d}.bin"


def _index_name(folder: str, part: int) -> str:
    return f"{folder}/index-{part:06d}.npz"


class _WholeFile:
    """A file that appears under its name only when it is complete."""

    def __init__(self, path: str):
        self.system, self.path = _file_system(path)
        self.system.create_dir(posixpath.dirname(self.path), recursive=True)
        self.written = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.written)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> None:
        """Rename; where another attempt was first and the store doesn't replace files, its equal bytes stay."""
        self.stream.close()
        try:
            self.system.move(self.written, self.path)
        except OSError:
            if not self.system.get_file_info(self.path).is_file:
                raise
            self.system.delete_file(self.written)


def _read_range(path: str, start: int, size: int) -> bytes:
    system, inside = _file_system(path)
    with system.open_input_file(inside) as source:
        return source.read_at(size, start)


# ---------------------------------------------------------------- tokens


#: Signs that a tokenizer of the kind in ``_letters_definition`` always parts from the letters before them.
SIGNS = ".,;:!?*&%#$"
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(SIGNS.encode())] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LATIN = np.zeros(256, dtype=bool)  # second bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def _letters_definition(definition: str) -> str | None:
    """The tokenizer for lower-case words of letters alone, set apart by blanks, or None where it is of another kind.

    It must lower case, keep letters and signs in different pieces, spell pieces by bytes and mark word ends, by its stated steps.
    """
    stated = json.loads(definition)
    steps, model = json.dumps(stated.get("normalizer") or {}), stated.get("model") or {}
    parts = (stated.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pieces = [p.get("pattern", {}).get("Regex", "") for p in parts]
    apart = any("[\\p{L}]+|" in p and p.endswith("[^\\s\\p{L}\\p{N}]+") for p in pieces)
    spelled = [p for p in parts if p.get("type") == "ByteLevel" and not p.get("use_regex", True) and not p.get("add_prefix_space", True)]
    if '"Lowercase"' not in steps or not apart or not spelled or model.get("type") != "BPE" or not model.get("end_of_word_suffix"):
        return None
    stated["normalizer"], stated["post_processor"] = None, None
    stated["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spelled[0]]}
    return json.dumps(stated)


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, one run after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before - first, size)


class WordEncoder:
    """Ids of distinct words, each encoded once while it is remembered.

    A word of letters with signs behind it is put together from its letters and its signs, where the tokenizer keeps these
    apart; letters are encoded many at a time by the tokenizer's model alone, which marks where each word ends. What is
    remembered are arrays: two 64-bit hashes of the encoded bytes, and the place of their ids.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.border = special[0] if special else None
        letters = _letters_definition(definition)
        self.letters = Tokenizer.from_str(letters) if letters else None
        if letters:
            suffix = json.loads(letters)["model"]["end_of_word_suffix"]
            self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.first, self.size, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, and how many each has."""
        ids, sizes = [np.zeros(0, dtype=np.uint32)], []
        for at in range(0, len(words), 4096):
            piece = [w.decode() for w in words[at : at + 4096]]
            if self.border is None or any(self.border[0] in w for w in piece):
                for e in self.tokenizer.encode_batch_fast(piece, add_special_tokens=False):
                    ids.append(np.array(e.ids, dtype=np.uint32))
                    sizes.append(len(e.ids))
                continue
            found = np.array(self.tokenizer.encode_batch_fast([self.border[0].join(piece)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cut = found == self.border[1]
            sizes += (np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(found)]])) - 1).tolist()
            ids.append(found[~cut])
        return np.concatenate(ids), np.array(sizes, dtype=np.int64)

    def _encode_letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(words), 16384):
            piece = words[at : at + 16384]
            found = np.array(self.letters.encode_batch_fast([b" ".join(piece).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            last = np.flatnonzero(self.ends[found])
            own = (found, np.diff(np.concatenate([[-1], last]))) if len(last) == len(piece) else self._encode(piece)
            ids.append(own[0])
            sizes.append(own[1])
        return np.concatenate(ids), np.concatenate(sizes)

    def _known(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Numbers of the remembered entries for byte runs; unknown ones are encoded first."""
        seeds = ((21, 22), (23, 24))
        key, check = (np.where(letters, _hashes(raw, start, end - start, a), _hashes(raw, start, end - start, b)) for a, b in seeds)
        at = self._look(key, check)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            if len(self.keys) + len(fresh) > REMEMBERED and len(self.keys):
                self.forget()
                fresh = np.arange(len(key))
            pairs = np.empty(len(fresh), dtype=[("key", np.uint64), ("check", np.uint64)])
            pairs["key"], pairs["check"] = key[fresh], check[fresh]
            fresh = fresh[np.unique(pairs, return_index=True)[1]]
            data = raw.tobytes()
            for which, encode in ((letters[fresh], self._encode_letters), (~letters[fresh], self._encode)):
                rows = fresh[which]
                ids, size = encode([data[a:b] for a, b in zip(start[rows].tolist(), end[rows].tolist())])
                self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
                self.size = np.concatenate([self.size, size])
                self.flat = np.concatenate([self.flat, ids])
                self.keys, self.checks = np.concatenate([self.keys, key[rows]]), np.concatenate([self.checks, check[rows]])
            order = np.lexsort((self.checks, self.keys))
            self.keys, self.checks, self.first, self.size = (x[order] for x in (self.keys, self.checks, self.first, self.size))
            at = self._look(key, check)
        return at

    def _look(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key)
        out = np.full(len(key), -1, dtype=np.int64)
        rows = np.flatnonzero(at < len(self.keys))
        while len(rows):  # equal keys stand next to each other
            rows = rows[self.keys[at[rows]] == key[rows]]
            met = self.checks[at[rows]] == check[rows]
            out[rows[met]] = at[rows[met]]
            rows = rows[~met]
            at[rows] += 1
            rows = rows[at[rows] < len(self.keys)]
        return out

    def ids(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words between ``edges`` in ``raw``, one word after another, and how many each has."""
        start, end = edges[:-1], edges[1:].copy()
        if self.letters is None:
            at = self._known(raw, start, end, np.zeros(len(start), dtype=bool))
            return self.flat[_places(self.first[at], self.size[at])], self.size[at]
        second = np.zeros(len(raw), dtype=bool)
        second[1:] = (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
        letter = _LETTER[raw] | second
        letter[:-1] |= second[1:]
        rows = np.arange(len(start))  # without the signs behind
        while len(rows):
            rows = rows[end[rows] > start[rows]]
            rows = rows[_SIGN[raw[end[rows] - 1]]]
            end[rows] -= 1
        counted = np.concatenate([[0], np.cumsum(letter)])
        plain = (counted[end] - counted[start] == end - start) & (end > start)
        low = raw.copy()
        low[(raw >= 65) & (raw <= 90)] += 32
        low[second & (raw <= 0x9E)] += 32
        both = np.concatenate([raw, low])
        end = np.where(plain, end, edges[1:])
        shift = np.where(plain, len(raw), 0)
        signed = np.flatnonzero(end < edges[1:])
        at = self._known(both, np.concatenate([start + shift, end[signed]]), np.concatenate([end + shift, edges[1:][signed]]), np.concatenate([plain, np.zeros(len(signed), dtype=bool)]))
        order = np.argsort(np.concatenate([np.arange(len(start)), signed]), kind="stable")  # signs right behind their letters
        at, size = at[order], self.size[at]
        each = size[: len(start)].copy()
        each[signed] += size[len(start) :]
        return self.flat[_places(self.first[at], self.size[at])], each


@lru_cache(maxsize=1)
def _encoder(definition: str) -> WordEncoder:
    return WordEncoder(definition)


def encode_column(definition: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a string column, and how many each row has.

    For tokenizers whose pieces never cross ASCII white space and drop it.
    """
    if column.null_count:
        column = column.fill_null("")
    words = pc.ascii_split_whitespace(column.cast(pa.large_string()))
    coded = words.flatten().dictionary_encode()
    flat, sizes = _encoder(definition).ids(*text_bytes(coded.dictionary))
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    length = sizes[which] if len(which) else np.zeros(0, dtype=np.int64)
    out = flat[_places((np.cumsum(sizes) - sizes)[which], length)] if len(which) else flat
    borders = words.offsets.to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(length)])
    return out, np.diff(upto[borders - borders[0]])


def _with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


def _row_ranges(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    _, borders = text_bytes(column)
    at = 0
    while at < len(column):
        to = min(max(int(np.searchsorted(borders, borders[at] + size, side="right")) - 1, at + 1), len(column))
        yield at, to
        at = to


def write_shards(docs: DataFrame, definition: str, folder: str, end_id: int, wide: bool, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shard files and return one manifest row per document, settled.

    ``definition`` is the tokenizer as JSON text; it is broadcast (a vocabulary file of a few MB, whatever
    the input). Rows are dealt by ranges of (id, text hash), so equal ids don't gather in one shard.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "<u4" if wide else "<u2"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        out, place, offset, last, copy = None, 0, 0, object(), 0
        for whole in batches:
            column = whole.column(1)
            for at, to in _row_ranges(column, 1 << 22):
                ids, sizes = _with_end(*encode_column(shared.value, column.slice(at, to - at)), end_id)
                if out is None:
                    out = _WholeFile(_shard_name(folder, shard))
                out.write(ids.astype(kind).tobytes())
                keys = whole.column(0).slice(at, to - at).to_pylist()
                copies = []
                for key in keys:
                    copy = copy + 1 if key == last else 0
                    last = key
                    copies.append(copy)
                rows = to - at
                starts = offset + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(np.full(rows, shard), pa.int32()), pa.array(np.arange(place, place + rows), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(copies, pa.int64())],
                    schema=MANIFEST_ARROW,
                )
                place += rows
                offset += int(sizes.sum())
        if out is not None:
            out.commit()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(count, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return settle(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with each document's first id in the whole order (``start``) and its ``copy`` number.

    Only one summary row per shard (and its first and last id) is summed across shards.
    """
    totals = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    runs = manifest.groupBy("shard", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    edges = runs.join(manifest.groupBy("shard").agg(F.max("place").alias("last")), "shard").filter((F.col("first") == 0) | (F.col("first") + F.col("rows") - 1 == F.col("last")))
    earlier = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("shard", "doc_id", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("carried")).filter("carried > 0")
    carried = carried.select(F.col("shard").alias("in_shard"), F.col("doc_id").alias("in_doc"), "carried")
    out = manifest.join(bases, "shard").join(carried, (F.col("shard") == F.col("in_shard")) & F.col("doc_id").eqNullSafe(F.col("in_doc")), "left")
    return out.select("doc_id", (F.col("copy_in_shard") + F.coalesce("carried", F.lit(0))).alias("copy"), "shard", "offset", (F.col("base") + F.col("offset")).alias("start"), "n_tokens")


# ---------------------------------------------------------------- index


def key_hashes(doc_ids: pa.Array, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes per key (id, copy): one places it, the other is its fingerprint."""
    missing = np.array(doc_ids.is_null())
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        tail = mix(copies.astype(np.uint64) * GOLDEN + missing.astype(np.uint64))
        place = mix(ids + tail)
        mark = mix(ids * GOLDEN ^ mix(tail + np.uint64(0xC2B2AE3D27D4EB4F)))
    return place, mark


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, each set where exactly one key fell.

    A key's slot is the number of set bits before its own. Keys still in collision after the last level
    (equal hashes among them) are kept in a sorted list beside it.
    """

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        self.ranks, total = [], 0
        for level in bits:
            counted = np.cumsum(level, dtype=np.int64)
            self.ranks.append(total + counted - level)
            total += int(counted[-1]) if len(counted) else 0
        self.taken = total

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & MASK64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, left = [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * GAMMA))
            spot = cls._spot(left, level, size)
            alone = np.bincount(spot, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[spot]]
        return cls(bits, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where the key is certainly absent. Keys of ``rest`` get its first equal entry."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_rows = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            if not len(open_rows):
                break
            spot = self._spot(keys[open_rows], level, len(bits))
            hit = bits[spot]
            out[open_rows[hit]] = ranks[spot[hit]]
            open_rows = open_rows[~hit]
        if len(open_rows) and len(self.rest):
            at = np.searchsorted(self.rest, keys[open_rows])
            same = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_rows])
            out[open_rows[same]] = self.taken + at[same]
        return out


INDEX_FIELDS = ("shard", "offset", "start", "n_tokens")


def pack_index(place: np.ndarray, mark: np.ndarray, values: dict[str, np.ndarray]) -> bytes:
    """An index file: level bits, fingerprints and values, by slot."""
    table = PerfectHash.build(place)
    slot = table.slots(place)
    equal = np.flatnonzero(slot >= table.taken)  # equal hashes share their first entry: spread them over the next ones
    if len(equal):
        order = equal[np.lexsort((mark[equal], slot[equal]))]
        slot[order] = table.taken + np.arange(len(order))
    marks = np.empty(len(place), dtype=np.uint64)
    marks[slot] = mark
    arrays = {"marks": marks, "rest": table.rest, "sizes": np.array([len(b) for b in table.bits], dtype=np.int64)}
    arrays["bits"] = np.packbits(np.concatenate(table.bits)) if table.bits else np.zeros(0, dtype=np.uint8)
    for name in INDEX_FIELDS:
        column = np.empty(len(place), dtype=np.int64)
        column[slot] = values[name]
        arrays[name] = column
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


class IndexFile:
    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as stored:
            self.arrays = {name: stored[name] for name in stored.files}
        sizes = self.arrays["sizes"]
        flat = np.unpackbits(self.arrays["bits"])[: int(sizes.sum())].astype(bool)
        self.table = PerfectHash(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], self.arrays["rest"])

    def find(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Slot of each key whose fingerprint is stored there, else -1."""
        slot = self.table.slots(place)
        marks = self.arrays["marks"]
        for row in np.flatnonzero(slot >= self.table.taken):  # among equal hashes the fingerprint decides
            while slot[row] < len(marks) - 1 and marks[slot[row]] != mark[row] and self.table.rest[slot[row] + 1 - self.table.taken] == place[row]:
                slot[row] += 1
        good = slot >= 0
        good[good] = marks[slot[good]] == mark[good]
        return np.where(good, slot, -1)


KEYS = "part int, doc_id long, copy long"


def _dealt_keys(rows: DataFrame, parts: int, *more: str) -> DataFrame:
    """Rows of one index part together, in one task that can hold several parts one after another."""
    part = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).cast("int")
    return rows.select(part.alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy"), *more).repartition(parts, "part").sortWithinPartitions("part")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    held, number = [], None
    for batch in batches:
        parts = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]])
        for at, to in zip(cuts[:-1], cuts[1:]):
            if at == to:
                continue
            if number is not None and parts[at] != number:
                yield number, pa.Table.from_batches(held).combine_chunks()
                held = []
            number = int(parts[at])
            held.append(batch.slice(at, to - at))
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def write_index(entries: DataFrame, folder: str, parts: int) -> DataFrame:
    """Write the index files over ``doc_id, copy, shard, offset, start, n_tokens``; returns ``part, n_keys``, settled.

    ``parts`` bounds a file's keys (a million or so at most): memory follows one file, not the corpus.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in _by_part(batches):
            place, mark = key_hashes(_one(table, "doc_id"), _one(table, "copy").to_numpy())
            out = _WholeFile(_index_name(folder, part))
            out.write(pack_index(place, mark, {name: _one(table, name).to_numpy().astype(np.int64) for name in INDEX_FIELDS}))
            out.commit()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_keys": pa.array([table.num_rows], pa.int64())})

    return settle(_dealt_keys(entries, parts, *INDEX_FIELDS).mapInArrow(build, "part int, n_keys long"), "token-index")


def resolved(keys: DataFrame, folder: str, parts: int) -> DataFrame:
    """``doc_id, copy, shard, offset, start, n_tokens`` of the keys that the index holds."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in _by_part(batches):
            system, inside = _file_system(_index_name(folder, part))
            with system.open_input_file(inside) as source:
                index = IndexFile(source.read())
            slot = index.find(*key_hashes(_one(table, "doc_id"), _one(table, "copy").to_numpy()))
            rows = np.flatnonzero(slot >= 0)
            kept = [_one(table, n).take(pa.array(rows)) for n in ("doc_id", "copy")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(index.arrays[n][slot[rows]], pa.int64()) for n in INDEX_FIELDS], schema=schema)

    return _dealt_keys(keys, parts).mapInArrow(find, "doc_id long, copy long, shard long, offset long, start long, n_tokens long")


def read_tokens(entries: DataFrame, folder: str, wide: bool, with_ids: bool = False) -> DataFrame:
    """Read each entry's ids from its shard: ``doc_id, copy, start, n_tokens, ids_crc32`` and, if asked, ``ids``.

    Entries of one shard are read in file order, in runs of up to 4 MB.
    """
    kind, width = ("<u4", 4) if wide else ("<u2", 2)
    fields = [("doc_id", pa.int64()), ("copy", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, offset, size = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("shard", "offset", "n_tokens"))
            sums, lists, at = [], [], 0
            while at < batch.num_rows:
                to = at + 1
                while to < batch.num_rows and shard[to] == shard[at] and offset[to] >= offset[at] and (offset[to] + size[to] - offset[at]) * width <= 1 << 22:
                    to += 1
                data = np.frombuffer(_read_range(_shard_name(folder, int(shard[at])), int(offset[at]) * width, int(offset[to - 1] + size[to - 1] - offset[at]) * width), dtype=kind)
                for row in range(at, to):
                    ids = data[int(offset[row] - offset[at]) :][: int(size[row])].astype("<u4")
                    sums.append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        lists.append(ids.astype(np.int32))
                at = to
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "copy", "start", "n_tokens")] + [pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), schema=schema)

    spread = entries.repartition("shard", F.floor(F.col("offset") / F.lit(1 << 22))).sortWithinPartitions("shard", "offset")
    return spread.mapInArrow(read, "doc_id long, copy long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def tokenizer_definition(path: str) -> tuple[str, bool]:
    """A tokenizer file's JSON text, and whether its ids need four bytes."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as source:
        definition = source.read()
    return definition, Tokenizer.from_str(definition).get_vocab_size() > 65_536


def stored_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", keys_per_index: int = 500_000) -> DataFrame:
    """Encode, write shards and index, resolve every key of ``docs`` through the index and read its ids back."""
    definition, wide = tokenizer_definition(tokenizer_path)
    folder = folder or shared_path(spark, "tokens")
    manifest = write_shards(docs, definition, folder, end_id, wide, id_col=id_col, text_col=text_col)
    entries = placed(manifest)
    parts = max(1, -(-manifest.count() // keys_per_index))
    parts = max(parts, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + parts * 8))
    write_index(entries, folder, parts)
    counted = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("rows"))
    keys = counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
    return read_tokens(resolved(keys, folder, parts), folder, wide)
