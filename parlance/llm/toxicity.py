"""Toxicity of deobfuscated text: a noisy channel over character lattices, then a learned rule list.

1. A character trigram model is counted over all documents.
2. A word that may be disguised (it holds a key of ``STANDS_FOR`` or ``SEPARATORS`` or a letter twice in a row, or it is
   one of a run of one-character words, with separators between them or not) becomes a lattice: each character stands
   for itself, for the letters it is used for, for nothing (a separator) or for a repetition of the letter before. Viterbi
   decoding takes the path that channel costs and character model make likeliest. Other words have one path.
   A word whose only oddity is a doubled letter is also read as it stands. Where signs at a word's end may be letters
   ("!diot") the word is read with and without them; a run of single letters
   is read as one word, without up to two letters at either end ("a s t u p i d"), and with word borders that Viterbi
   places. A word or run counts once, by its strongest reading.
3. Features of a restored word are the word and its first 4 to 7 bytes. From labelled rows a rule list is learned:
   features that are precise for label 1: all that are wide and sure, and others, the widest first, while they explain rows that no earlier one
   explains. A
   document's score is the noisy-or of its rules' precisions.

Cases: a null or blank text scores the rate of toxic rows that no rule explains; labels without a value or id
are not used, of several labels of an id the highest counts; a document without id is scored, and is not held out;
repeated rows are scored alike; without labels of both classes every score is the share of label 1; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import words as W
from parlance.session import settle

SYMBOLS = 64
#: Labelled rows of each class that the rules are learned from, at most: the first by a hash of their id.
TOXIC_ROWS, CLEAN_ROWS = 6_000, 18_000
PREFIXES = (4, 5, 6, 7)
PRECISE, WORTH = 0.9, 0.75
#: A feature of this share of the toxic rows and this precision is a rule whatever else explains its rows.
WIDE, SURE = 0.03, 0.98
#: Decoded words that a task remembers, some 300 bytes each; beyond it, it forgets them all and starts again.
REMEMBERED = 50_000
#: Bytes of text that are read at a time, and features that rules are chosen from, the widest and surest first.
SLICE, MOST_FEATURES = 1 << 18, 50_000

# Letters that characters are used for
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
SEPARATORS = ".-_*'·,~^/\\:"
PUNCTUATION = "!(¡"  # keys of STANDS_FOR that often stand beside a word as signs

SWAP, DROP, KEEP = 1.0, 0.5, 9.0  # channel costs
DOUBLED, REPEATED = 6.0, 0.7  # of leaving out a letter from a pair, and from a longer run
#: A run of single letters is also read without up to so many at either end: they may be words of their own.
ENDS = 2

_EDGE = np.zeros(256, dtype=bool)  # signs that end a word and are no part of it
_EDGE[[ord(c) for c in "\"'()[]{}<>.,;:?!*&%#~^=/\\-_`"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _marked(signs: str) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[[ord(c) for c in signs if c.isascii()]] = True
    return flags


_STANDS, _SEPARATES, _SOFT = _marked("".join(STANDS_FOR)), _marked(SEPARATORS), _marked("".join(c for c in STANDS_FOR if not c.isdigit()))
_WIDE = [(c, c.encode()) for c in (*STANDS_FOR, *SEPARATORS) if not c.isascii()]


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x10000: 0 no letter, 1-26 a-z, the rest shares 27-63."""
    table = np.zeros(0x10000, dtype=np.uint8)
    for point in range(0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()[0]
            table[point] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SYMBOLS - 27)
    return table


def symbol(letter: str) -> int:
    return int(symbol_table()[min(ord(letter), 0xFFFF)])


# ---------------------------------------------------------------- character model


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, seen`` over all whole texts; 64 x 64 x 64 grams at most, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = symbol_table(), np.zeros(SYMBOLS**3, dtype=np.int64)
        for whole in batches:
            for batch in W.slices(whole, "text"):
                text = "\n".join(t for t in batch.column(0).to_pylist() if t)
                points = np.frombuffer(("\n" + text + "\n").encode("utf-32-le"), dtype=np.uint32)
                codes = table[np.minimum(points, 0xFFFF)].astype(np.int32)
                codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one border between words
                if len(codes) > 2:
                    total += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["gram", "seen"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "gram int, seen long")
    return found.groupBy("gram").agg(F.sum("seen").alias("seen"))


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a symbol after two others, interpolated with the shorter contexts."""
    rows = trigram_counts(docs, text_col).toArrow()
    three = np.zeros(SYMBOLS**3)
    three[rows.column("gram").to_numpy()] = rows.column("seen").to_numpy()
    three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    base = (one + 1) / (one.sum() + SYMBOLS)
    after_one = (two + 20 * base) / (two.sum(axis=1, keepdims=True) + 20)
    after_two = (three + 20 * after_one[None]) / (three.sum(axis=2, keepdims=True) + 20)
    return np.log(after_two).astype(np.float32)


# ---------------------------------------------------------------- decoding


class Decoder:
    """Viterbi decoding of one word under the channel and the character model."""

    def __init__(self, model: np.ndarray):
        self.flat = model.reshape(-1).tolist()
        self.known: dict[str, tuple[str, float]] = {}
        self.known_runs: dict[str, tuple[str, ...]] = {}

    def restore(self, word: str) -> str:
        return self.judged(word)[0]

    def judged(self, word: str) -> tuple[str, float]:
        """The decoded word and its cost."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = self._decode(word)
        return found

    def readings(self, run: str) -> tuple[str, ...]:
        """What a run of single characters may say: words between likely borders, and one word, the run's ends in it or not."""
        found = self.known_runs.get(run)
        if found is None:
            if len(self.known_runs) >= REMEMBERED // 20:
                self.known_runs.clear()
            whole = [run[a : len(run) - b] for a in range(ENDS + 1) for b in range(ENDS + 1) if len(run) - a - b > 1]
            found = self.known_runs[run] = tuple(dict.fromkeys([*self.split(run), *map(self.restore, whole)]))
        return found

    def split(self, run: str) -> list[str]:
        """The run as words, their borders placed by Viterbi decoding."""
        flat = self.flat
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for char in run.lower():
            letters, swap = STANDS_FOR.get(char) or char, SWAP if char in STANDS_FOR else 0.0
            for (two, one), (cost, path) in list(states.items()):
                border = cost - flat[(two * SYMBOLS + one) * SYMBOLS]
                if one and ((0, 0) not in states or border < states[0, 0][0]):
                    states[0, 0] = (border, (path, " "))
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (two, one), (cost, path) in states.items():
                for letter in letters:
                    code = symbol(letter)
                    total = cost + swap - flat[(two * SYMBOLS + one) * SYMBOLS + code]
                    if (one, code) not in after or total < after[one, code][0]:
                        after[one, code] = (total, (path, letter))
            states = after
        _, path = min(((cost - flat[(two * SYMBOLS + one) * SYMBOLS], path) for (two, one), (cost, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out)).split()

    @staticmethod
    def _run_lengths(word: str) -> list[int]:
        return [len(run[0]) for run in re.finditer(r"(.)\1*", word, flags=re.S) for _ in run[0]]

    def _decode(self, word: str) -> tuple[str, float]:
        flat = self.flat
        word = re.sub(r"(.)\1{3,}", r"\1\1\1", word.lower(), flags=re.S)
        # state: the last two symbols and the last letter; value: cost and the letters so far
        states: dict[tuple, tuple[float, str]] = {(0, 0, ""): (0.0, "")}
        for char, run in zip(word, self._run_lengths(word)):
            letters = STANDS_FOR.get(char) or (char if symbol(char) else "")
            swap = SWAP if char in STANDS_FOR else 0.0
            after: dict[tuple, tuple[float, str]] = {}

            def offer(state: tuple, cost: float, text: str) -> None:
                best = after.get(state)
                if best is None or (cost, text) < best:
                    after[state] = (cost, text)

            for (two, one, last), (cost, text) in states.items():
                for letter in letters:
                    code = symbol(letter)
                    offer((one, code, letter), cost + swap - flat[(two * SYMBOLS + one) * SYMBOLS + code], text + letter)
                    if letter == last:
                        offer((two, one, last), cost + swap + (REPEATED if run > 2 else DOUBLED), text)
                if char in SEPARATORS or char == " ":
                    offer((two, one, ""), cost + DROP, text)
                elif char not in letters:
                    offer((0, 0, ""), cost + KEEP, text + char)
            states = after
        cost, text = min((cost - flat[(two * SYMBOLS + one) * SYMBOLS] if one else cost, text) for (two, one, _), (cost, text) in states.items())
        return text, cost


def _trimmed(start: np.ndarray, end: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without the marked bytes at their ends."""
    start, end = start.copy(), end.copy()
    for moving, step in ((start, 1), (end, -1)):
        rows = np.arange(len(start))
        while len(rows):
            rows = rows[start[rows] < end[rows]]
            at = start[rows] if step == 1 else end[rows] - 1
            rows = rows[edge[at]]
            moving[rows] += step
    return start, end


def _widened(start: np.ndarray, end: np.ndarray, least: np.ndarray, most: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends with the marked bytes beside them, within ``least`` and ``most``."""
    start, end = start.copy(), end.copy()
    rows = np.arange(len(start))
    while len(rows):
        rows = rows[start[rows] > least[rows]]
        rows = rows[taken[start[rows] - 1]]
        start[rows] -= 1
    rows = np.arange(len(end))
    while len(rows):
        rows = rows[end[rows] < most[rows]]
        rows = rows[taken[end[rows]]]
        end[rows] += 1
    return start, end


def _counted(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    return total[end] - total[start]


def _letter_at(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the characters of so many bytes at these places have a symbol."""
    out = np.zeros(len(at), dtype=bool)
    for k in np.flatnonzero(size > 0):
        out[k] = symbol(raw[at[k] : at[k] + size[k]].tobytes().decode(errors="replace")[0]) > 0
    return out


@dataclass
class Gate:
    """Which words get a lattice, by the tables of the channel, and which stand together as runs of single characters."""

    start: np.ndarray  # without signs that end a word
    end: np.ndarray
    outer_start: np.ndarray  # with signs beside it that may be letters
    outer_end: np.ndarray
    noisy: np.ndarray  # the word without these signs needs decoding
    doubled: np.ndarray  # for its doubled letters only: it may also be plain
    runs: list[np.ndarray]  # members of runs of three or more one-character words of a row, the separators between left out
    inside: np.ndarray  # words of a run, the separators between included


def gated(found: W.Words, row: np.ndarray) -> Gate:
    raw = found.raw
    begins = (raw & 0xC0) != 0x80
    letter, stands, separates, soft = _LETTER[raw] & begins, _STANDS[raw], _SEPARATES[raw], _SOFT[raw]
    edge = _EDGE[raw] | soft
    for char, code in _WIDE:
        at = np.flatnonzero(raw[: max(0, len(raw) - len(code) + 1)] == code[0])
        for k in range(1, len(code)):
            at = at[raw[at + k] == code[k]]
        letter[at] = False
        (stands if char in STANDS_FOR else separates)[at] = True
        for k in range(len(code)):
            edge[at + k] = True
            soft[at + k] = char in STANDS_FOR
    low, twice = W._LOWER[raw], np.zeros(len(raw), dtype=bool)  # the second of two equal letters
    for size in (1, 2, 3, 4):
        lead = (raw < 0x80) if size == 1 else (raw >> (7 - size)) == (1 << (size + 1)) - 2
        at = np.flatnonzero((lead & letter)[: max(0, len(raw) - 2 * size + 1)])
        for k in range(size):
            at = at[low[at + k] == low[at + size + k]]
        twice[at + size] = True
    plain_start, plain_end = _trimmed(found.start, found.end, _EDGE[raw])
    start, end = _trimmed(found.start, found.end, edge)
    letters = _counted(letter, start, end)
    bare = letters == 0  # numbers and signs: read as they stand
    size = _counted(begins, start, end)
    signs = _counted(stands | separates, start, end) > 0
    noisy = ~bare & (size > 1) & (signs | (_counted(twice, np.minimum(start + 1, end), end) > 0))
    # one-character words: a letter or digit, or a sign alone that may be a letter
    whole = _counted(begins, found.start, found.end)
    sign = (size == 0) & (whole == 1) & (_counted(stands, found.start, found.end) == 1)
    single = (size == 1) & (_counted(stands | letter, start, end) > 0)
    wide = np.flatnonzero(single & (end - start > 1))
    single[wide] = _letter_at(raw, start[wide], end[wide] - start[wide])
    single |= sign
    between = ~single & (whole > 0) & (_counted(separates, found.start, found.end) == whole)
    read = np.flatnonzero(~between)
    one = single[read]
    joined = np.concatenate([[False], one[1:] & one[:-1] & (row[read][1:] == row[read][:-1]), [False]]) if len(read) else np.zeros(1, dtype=bool)
    first, last = np.flatnonzero(~joined[:-1] & joined[1:]), np.flatnonzero(joined[:-1] & ~joined[1:])
    runs = [read[a : b + 1] for a, b in zip(first.tolist(), last.tolist()) if b - a >= 2]
    inside = np.zeros(len(start), dtype=bool)
    for members in runs:
        inside[members[0] : members[-1] + 1] = True
    outer_start, outer_end = _widened(start, end, found.start, found.end, soft)
    start, end = np.where(bare, plain_start, start), np.where(bare, plain_end, end)
    start, end = np.where(sign, found.start, start), np.where(sign, found.end, end)
    outer_start, outer_end = np.where(bare, start, outer_start), np.where(bare, end, outer_end)
    return Gate(start, end, outer_start, outer_end, noisy, noisy & ~signs, runs, inside)


def restored_words(column: pa.Array, decoder: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends, rows and word numbers of all readings of all words after decoding; they keep no order within a row."""
    found = W.words_of(column, lower=True)
    row = np.repeat(np.arange(len(column)), np.diff(found.first))
    gate = gated(found, row)
    alone = ~gate.inside & (gate.end > gate.start)
    at = np.flatnonzero(alone & (~gate.noisy | gate.doubled))
    before, behind = alone & (gate.outer_start < gate.start), alone & (gate.outer_end > gate.end)
    numbers, texts = [], []
    for which, starts, ends in (
        (alone & gate.noisy, gate.start, gate.end),
        (before, gate.outer_start, gate.end),
        (behind, gate.start, gate.outer_end),
        (before & behind, gate.outer_start, gate.outer_end),
    ):
        picked = np.flatnonzero(which)
        numbers += picked.tolist()
        texts += [found.raw[a:b].tobytes().decode(errors="replace") for a, b in zip(starts[picked].tolist(), ends[picked].tolist())]
    decoded = [decoder.restore(t).encode() for t in texts]
    for members in gate.runs:
        readings = decoder.readings(b"".join(found.raw[gate.start[i] : gate.end[i]].tobytes() for i in members).decode(errors="replace"))
        decoded += [r.encode() for r in readings]
        numbers += [int(members[0])] * len(readings)
    size = np.fromiter(map(len, decoded), dtype=np.int64, count=len(decoded))
    extra = len(found.raw) + np.cumsum(size) - size
    raw = np.concatenate([found.raw, np.frombuffer(b"".join(decoded), dtype=np.uint8)])
    number = np.concatenate([at, np.array(numbers, dtype=np.int64)])
    return raw, np.concatenate([gate.start[at], extra]), np.concatenate([gate.end[at], extra + size]), row[number], number


def _weighed(decoder: Decoder, before: str, word: str, behind: str) -> tuple[float, str]:
    """Cost per symbol of a word whose signs at the ends stay signs, and the decoded word; punctuation stays for nothing."""
    text, cost = decoder.judged(word)
    kept = sum(c not in PUNCTUATION for c in before + behind)
    return (cost + KEEP * kept) / (len(text) + 1 + kept), text


def restore_text(text: str, decoder: Decoder) -> str:
    """A text with its disguised words decoded, each by its likeliest reading; white space becomes one blank."""
    found = W.words_of(pa.array([text]), lower=False)
    gate = gated(found, np.zeros(len(found.start), dtype=np.int64))
    runs = {int(members[0]): members for members in gate.runs}
    piece = lambda a, b: found.raw[a:b].tobytes().decode()
    out, i = [], 0
    while i < len(gate.start):
        if i in runs:
            out += decoder.split("".join(piece(gate.start[k], gate.end[k]) for k in runs[i]))
            i = int(runs[i][-1]) + 1
            continue
        start, end = gate.start[i], gate.end[i]
        spans = {(a, b) for a in (start, gate.outer_start[i]) for b in (end, gate.outer_end[i])}
        inside = piece(start, end)
        if len(spans) > 1 or gate.noisy[i]:
            _, said, start, end = min(_weighed(decoder, piece(gate.outer_start[i], a), piece(a, b), piece(b, gate.outer_end[i])) + (a, b) for a, b in spans)
            inside = said if gate.noisy[i] or (start, end) != (gate.start[i], gate.end[i]) else inside
        out.append(piece(found.start[i], start) + inside + piece(end, found.end[i]))
        i += 1
    return " ".join(out)


def restored(docs: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with its text column restored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [None if t is None else restore_text(t, decoder) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


# ---------------------------------------------------------------- features and rules


def word_features(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word and its prefixes, one column each; a prefix as long as the word counts as such."""
    columns = [W._hashes(raw, start, end - start, seed=41)]
    for size in PREFIXES:
        columns.append(np.where(end - start >= size, W._hashes(raw, start, np.minimum(end - start, size), seed=42 + size), np.uint64(0)))
    return np.stack(columns, axis=1)


def row_features(column: pa.Array, decoder: Decoder) -> Iterator[np.ndarray]:
    """Distinct feature hashes of each row."""
    raw, start, end, row, _ = restored_words(column, decoder)
    marks = word_features(raw, start, end)
    order = np.argsort(row, kind="stable")
    marks, row = marks[order], row[order]
    border = np.searchsorted(row, np.arange(len(column) + 1))
    for i in range(len(column)):
        own = np.unique(marks[border[i] : border[i + 1]])
        yield own[own != 0]


def learnable(labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id, toxic`` of the labelled ids outside the held-out fold, each once."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return known.filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0)


def training_sample(known: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """The rows of ``learnable`` labels, bounded for each class."""
    picked = [known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for value, rows in ((1, toxic_rows), (0, clean_rows))]
    return picked[0].unionAll(picked[1])


def learned_rules(docs: DataFrame, labels: DataFrame, model: np.ndarray, toxic_rows: int, clean_rows: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes with their precisions, and the score of a text without any of them.

    The rows are a bounded sample: their ids are broadcast; of their features at most ``MOST_FEATURES`` that pass every test reach the
    driver, and which of them each toxic row has. Of rows of a class with the same
    four lowest feature hashes (copies, near copies mostly) one is learned from.
    """
    spark = docs.sparkSession
    taught = learnable(labels)
    sample = settle(training_sample(taught, toxic_rows, clean_rows), "toxic-sample")
    shares = {r["toxic"]: r["n"] for r in taught.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = spark.sparkContext.broadcast(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for whole in batches:
            for batch in W.slices(whole, "text", SLICE):
                lists = [x.tobytes() for x in row_features(batch.column(1), decoder)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.binary())], names=["doc_id", "toxic", "marks"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")
    gathered = texts.mapInArrow(gather, "doc_id long, toxic int, marks binary").withColumn("low", F.substring("marks", 1, 32))
    one = gathered.groupBy("toxic", "low").agg(F.min_by(F.struct("doc_id", "marks"), "doc_id").alias("row"))
    rows = settle(one.select("toxic", "row.doc_id", "row.marks"), "toxic-features")
    counts = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    total = {r["toxic"]: r["n"] for r in counts}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    none = (np.zeros(0, dtype=np.uint64), np.zeros(0), share)
    if not total.get(0) or not total.get(1):
        return none

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            label = batch.column(0).to_numpy()
            lists = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(1).to_pylist()]
            for value in (0, 1):
                flat = [x for x, y in zip(lists, label) if y == value]
                mark, seen = np.unique(np.concatenate(flat), return_counts=True) if flat else (np.zeros(0, dtype=np.uint64), np.zeros(0))
                zero = np.zeros(len(mark), dtype=np.int64)
                pair = (zero, seen.astype(np.int64)) if value else (seen.astype(np.int64), zero)
                yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(pair[0]), pa.array(pair[1])], names=["mark", "clean", "toxic"])

    sums = rows.select("toxic", "marks").mapInArrow(counted, "mark long, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # rates stand for all labelled ids outside the held-out fold, whatever the classes' shares in the sample
    odds = (F.col("toxic") / F.lit(total[1]) * F.lit(share)) / (F.col("toxic") / F.lit(total[1]) * F.lit(share) + (F.col("clean") + F.lit(0.05)) / F.lit(total[0]) * F.lit(1 - share))
    # a feature that clean rows explain just as well must be rarer than one in e^2 among all features (Chernoff's bound)
    sums = settle(sums, "toxic-counts")
    expected = (F.col("clean") + F.lit(1)) * F.lit(total[1] / total[0])
    chance = F.col("toxic") * F.log(expected / F.col("toxic")) + F.col("toxic") - expected
    surprise = math.log(max(2, sums.count())) + 2
    least = 2
    usable = sums.withColumn("precision", odds).filter((F.col("toxic") > expected) & (chance <= -surprise) & (F.col("precision") >= PRECISE))
    usable = usable.orderBy(F.desc(F.col("toxic") * F.pow("precision", F.lit(30.0))), "mark").limit(MOST_FEATURES).toArrow()
    marks = usable.column("mark").to_numpy().view(np.uint64)
    precision = usable.column("precision").to_numpy()
    by_mark = np.argsort(marks, kind="stable")
    sorted_marks = spark.sparkContext.broadcast(marks[by_mark])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted_marks.value
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            lists = [np.flatnonzero(np.isin(known, np.frombuffer(x, dtype=np.uint64))).astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "met"])

    toxic = rows.filter("toxic = 1").select("doc_id", "marks").mapInArrow(met, "doc_id long, met array<int>").orderBy("doc_id").toArrow().column("met").to_pylist()
    members: list[list[int]] = [[] for _ in marks]
    for number, own in enumerate(toxic):
        for k in own:
            members[by_mark[k]].append(number)
    # a rule is wide and sure, or worth it for the rows that it alone explains, against all clean rows that it meets
    against = (usable.column("clean").to_numpy() + 0.05) / total[0] * (1 - share)
    explained, chosen = np.zeros(len(toxic), dtype=bool), []
    for k, rows_of in enumerate(members):
        fresh = [n for n in rows_of if not explained[n]]
        gain = len(fresh) / total[1] * share
        wide = len(rows_of) >= max(5, WIDE * total[1]) and precision[k] >= SURE
        if wide or (len(fresh) >= least and gain / (gain + against[k]) >= WORTH):
            explained[fresh] = True
            chosen.append(k)
    chosen = np.array(chosen, dtype=np.int64)
    order = np.argsort(marks[chosen], kind="stable")
    left = share * (1 - explained.mean())
    return marks[chosen][order], np.minimum(precision[chosen][order], 0.999), float(left / (left + 1 - share)) if share < 1 else share


SCORES = "doc_id long, held_out boolean, score double, text_hash long"


def scores(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, text_hash`` of every row."""
    model = character_model(docs, text_col)
    rules = learned_rules(docs, labels, model, toxic_rows, clean_rows, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (known, precision, base) = shared.value
        decoder = Decoder(model)
        for whole in batches:
            for batch in W.slices(whole, "text", SLICE):
                raw, start, end, row, number = restored_words(batch.column(3), decoder)
                doubt = np.zeros(batch.num_rows)
                if len(known) and len(row):
                    marks = word_features(raw, start, end)
                    spot = np.minimum(np.searchsorted(known, marks), len(known) - 1)
                    strength = np.where(known[spot] == marks, precision[spot], 0.0).max(axis=1)
                    hit = np.flatnonzero(strength)
                    hit = hit[np.lexsort((-strength[hit], number[hit]))]
                    hit = hit[np.unique(number[hit], return_index=True)[1]]  # a word counts once
                    np.add.at(doubt, row[hit], np.log1p(-strength[hit]))
                score = pa.array(1 - np.exp(doubt) * (1 - base), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score, batch.column(2)], names=["doc_id", "held_out", "score", "text_hash"])

    ids = F.col(id_col).cast("long")
    held_out = F.coalesce(F.crc32(ids.cast("string")) % 5 == 0, F.lit(False))
    read = docs.select(ids.alias("doc_id"), held_out.alias("held_out"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, SCORES)
