"""Structure repair of conversations: the cheapest edits that make their roles read ``(s?(ua)+)?``, found by ``auction``.

Rows are ``conv_id, turn, role, text``; a conversation's rows are read by turn (nulls first), rows of one turn by role and text. A
row's first fault counts: blank (nothing but the six ASCII white-space characters), duplicate (role and text occurred earlier),
truncated (its last other character is none of ``.!?``). Blank and duplicate rows must be deleted.

A conversation of up to ``ROWS`` rows and ``BYTES`` bytes is repaired within one task, many at a time. A longer one is dealt over
all tasks in pieces, cut anywhere along its order: a piece gives the distances between the states before and behind it; these
matrices, a row per piece, are walked back through the conversation to price each piece's end, each piece is then traced from any state
before it, and a walk forth says from which. Texts never meet in one task, but for those of one piece.

Cases: null roles and texts count as one space (so such a text is blank, such a role none of user, assistant and system), in ids and
turns nulls are one space where a text is made of them; rows without conversation id are one conversation; repeated rows are
duplicates of each other; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import auction
from parlance.session import parallelism, settle

SPACE = " \t\n\x0b\x0c\r"
#: A conversation beyond one of these is repaired in pieces of as much.
ROWS, BYTES = 1024, 8 << 20
#: Conversations that are auctioned together hold about so many rows.
TOGETHER = 16_384

COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
LINES = "array<struct<role:string,text:string>>"
PIECE = f"conv_id long, piece long, pieces long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired {LINES}"
_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PIECE = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("pieces", pa.int64()), ("gaps", pa.int64())] + [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("repaired", _LINES)]
)
LEGAL = frozenset(("su", "ua", "au"))
BLANK, DUPLICATE = 1, 2  # of the column fault; 3 is truncated


def damaged(convs: DataFrame) -> DataFrame:
    """Rows as the exercise damages them, by crc32(``conv_id:turn``) % 20: 0 goes, 1 loses its text, 2 its ``.!?``, 3 comes twice, 4 is a user's."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    rows = convs.filter(lot != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(lot == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(lot == 3, 2).otherwise(1))).alias("again"),
    )
    return rows.drop("again")


def _fault(text: Column) -> Column:
    """Blank or truncated; duplicates are known later."""
    ink = F.btrim(text, F.lit(SPACE))
    return F.when(ink == "", BLANK).when(F.right(ink, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)


def _kind(initial: str, fault: int) -> int:
    sort = auction.SOUND if not fault else auction.TRUNCATED if fault == 3 else auction.FORCED
    return auction.INITIALS.get(initial, auction.OTHER) * 3 + sort


def _written(rows: list[tuple[str, str]], audit: bytes, state: int) -> tuple[list[dict], int]:
    """What an audit makes of its rows (role, text), and the state behind it."""
    out, at = [], 0
    for letter in audit:
        if letter == 68:  # D
            at += 1
            continue
        role = "assistant" if state == auction.USER else "user"
        if letter == 73:  # I
            text = ""
        else:
            if letter == 75:  # K
                role = rows[at][0]
            text = rows[at][1]
            at += 1
        state = auction.SYSTEM if letter == 75 and state == auction.START and role[:1] == "s" else auction.ASSISTANT if state == auction.USER else auction.USER
        out.append({"role": role, "text": text})
    return out, state


def _ended(letters: bytes, state: int, rows: list[tuple[str, str]], entry: int) -> tuple[str, list[dict]]:
    """Audit and lines of a conversation's last rows, with what is inserted behind them."""
    letters = letters + auction.TAIL_LETTERS[state].encode()
    return letters.decode(), _written(rows, letters, entry)[0]


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``conv_id, turn, role, text, fault`` in order, to a piece per conversation."""
    done: list[list] = []  # per conversation: id, turns, rows, faults
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        kinds, first, out = [], [0], []
        for conv_id, turns, rows, faults in done:
            seen, counts, before, illegal = set(), [0, 0, 0, 0], None, 0
            for row, fault in zip(rows, faults):
                if fault != BLANK:
                    if row in seen:
                        fault = DUPLICATE
                    else:
                        seen.add(row)
                counts[fault] += 1
                initial = row[0][:1]
                illegal += before is not None and before + initial not in LEGAL
                before = initial
                kinds.append(_kind(initial, fault))
            first.append(len(kinds))
            known = sorted({t for t in turns if t is not None})
            gaps = known[-1] - known[0] + 1 - len(known) if known else 0
            out.append({"conv_id": conv_id, "piece": 0, "pieces": 1, "gaps": gaps, "blank": counts[1], "duplicate": counts[2], "truncated": counts[3], "illegal": illegal})
        lattices, choices = auction.Lattices(np.array(kinds, dtype=np.int64), np.array(first)), []
        cost = lattices.distances(np.repeat(auction.TAIL[None], len(done), 0), (auction.START,), choices)[:, auction.START]
        audits, states = lattices.traced(choices, np.zeros(len(done), dtype=np.int64))
        for row, (_, _, rows, _), paid, letters, state in zip(out, done, cost.tolist(), audits, states.tolist()):
            row["cost"] = paid
            row["audit"], row["repaired"] = _ended(letters, state, rows, auction.START)
        done.clear()
        yield pa.RecordBatch.from_pylist(out, schema=_PIECE)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv_id, turn, role, text, fault in zip(*columns):
            if not done or done[-1][0] != conv_id:
                if held >= TOGETHER:
                    yield from flushed()
                    held = 0
                done.append([conv_id, [], [], []])
            _, turns, rows, faults = done[-1]
            turns.append(turn)
            rows.append((role, text))
            faults.append(fault)
            held += 1 + (len(text) >> 9)  # long texts count as several rows
    if done:
        yield from flushed()


# ---------------------------------------------------------------- long conversations


_CUT = f"conv_id long, part int, piece long, kinds binary, matrix array<long>, first string, last string, illegal long, blank long, duplicate long, truncated long, rows {LINES}"
_CUT_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("kinds", pa.binary()), ("matrix", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated")]
    + [("rows", _LINES)]
)


def _cut(row_limit: int, byte_limit: int):
    """Rows in order, with how often each occurs, to pieces with their matrices. Rows that must go keep no text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        conv_id, rows, faults, size, begun = None, [], [], 0, False

        def piece() -> pa.RecordBatch:
            nonlocal number
            initials = [role[:1] for role, _ in rows]
            kinds = np.array([_kind(i, f) for i, f in zip(initials, faults)], dtype=np.uint8)
            matrix = auction.Lattices(kinds, np.array([0, len(kinds)])).matrices()[0]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            out = {"conv_id": conv_id, "part": part, "piece": number, "kinds": kinds.tobytes(), "matrix": matrix.reshape(-1).tolist(), "first": initials[0], "last": initials[-1]}
            out |= {"illegal": illegal, "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3), "rows": [{"role": r, "text": t} for r, t in rows]}
            number += 1
            return pa.RecordBatch.from_pylist([out], schema=_CUT_SCHEMA)

        for batch in batches:
            for this, role, text, fault, times in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and this != conv_id and rows:
                    yield piece()
                    rows, faults, size = [], [], 0
                conv_id, begun = this, True
                for again in range(times):
                    now = fault if fault in (BLANK, DUPLICATE) or not again else DUPLICATE
                    forced = now in (BLANK, DUPLICATE)
                    rows.append((role, "" if forced else text))
                    faults.append(now)
                    size += 0 if forced else len(text)
                    if len(rows) >= row_limit or size >= byte_limit:
                        yield piece()
                        rows, faults, size = [], [], 0
        if rows:
            yield piece()

    return cut


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices from a conversation's last piece to its first, to the distances behind and before each."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("ahead", pa.list_(pa.int64())), ("cost", pa.int64())])
    conv_id, ahead, begun = None, auction.TAIL, False
    for batch in batches:
        out = []
        for this, part, piece, matrix in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or this != conv_id:
                conv_id, ahead, begun = this, auction.TAIL, True
            before = np.minimum((np.array(matrix, dtype=np.int64).reshape(4, 4) + ahead).min(axis=1), auction.FAR)
            out.append({"conv_id": this, "part": part, "piece": piece, "ahead": ahead.tolist(), "cost": int(before[auction.START])})
            ahead = before
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the distances behind them, to their letters from each state before them and the states behind."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("letters", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])
    for whole in batches:
        for batch in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
            kinds = [np.frombuffer(x, dtype=np.uint8) for x in batch.column(3).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(k) for k in kinds])])
            lattices, choices = auction.Lattices(np.concatenate(kinds), first), []
            lattices.distances(np.array(batch.column(4).to_pylist(), dtype=np.int64), choices=choices)
            found = [lattices.traced(choices, np.full(len(kinds), entry)) for entry in range(4)]
            letters = [[found[e][0][k].decode() for e in range(4)] for k in range(len(kinds))]
            exits = [[int(found[e][1][k]) for e in range(4)] for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(letters, schema.field(3).type), pa.array(exits, schema.field(4).type)], schema=schema)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, to each one's number, the state before it, its letters, and whether it begins against the role before it."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("number", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64()), ("audit", pa.string()), ("border", pa.int64())])
    conv_id, number, state, before, begun = None, 0, auction.START, None, False
    for batch in batches:
        out = []
        for this, part, piece, letters, exits, first, last in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or this != conv_id:
                conv_id, number, state, before, begun = this, 0, auction.START, None, True
            border = int(before is not None and before + first not in LEGAL)
            out.append({"conv_id": this, "part": part, "piece": piece, "number": number, "entry": state, "exit": exits[state], "audit": letters[state], "border": border})
            number, state, before = number + 1, exits[state], last
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their letters, to pieces of the result."""
    for batch in batches:
        for row in batch.to_pylist():
            last = row["number"] == row["pieces"] - 1
            lines = [(r["role"], r["text"]) for r in row["rows"]]
            if last:
                row["audit"], row["repaired"] = _ended(row["audit"].encode(), row["exit"], lines, row["entry"])
            else:
                row["repaired"], _ = _written(lines, row["audit"].encode(), row["entry"])
            row["piece"] = row["number"]
            row["gaps"], row["cost"] = (row["gaps"], row["cost"]) if not row["number"] else (0, 0)
            row["illegal"] += row["border"]
            yield pa.RecordBatch.from_pylist([{name: row[name] for name in _PIECE.names}], schema=_PIECE)


def _in_pieces(rows: DataFrame, row_limit: int, byte_limit: int) -> DataFrame:
    """Pieces of long conversations."""
    tasks = parallelism(rows)
    # equal rows are one with a count before they travel; of a duplicate the earliest turn counts
    digest = F.sha2("text", 256)
    known = settle(rows.groupBy("conv_id", "turn", "role", "text", "fault").agg(F.count(F.lit(1)).alias("times")).withColumn("digest", digest), "repair-rows")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    earliest = known.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order)["turn"].alias("t"))
    met = known.join(earliest, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    later = (F.col("fault") != BLANK) & ~F.col("turn").eqNullSafe(F.col("t"))
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = met.select("conv_id", "turn", "role", F.when(later, DUPLICATE).otherwise(F.col("fault")).alias("fault"), "times", "text").repartitionByRange(tasks, *keys)
    ordered = dealt.sortWithinPartitions(*keys).select("conv_id", "role", "text", "fault", "times")
    cut = settle(ordered.mapInArrow(_cut(row_limit, byte_limit), _CUT), "repair-pieces")
    place = ["conv_id", "part", "piece"]
    walked = cut.select(*place, "matrix").repartition(tasks, "conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("piece"))
    priced = settle(walked.mapInArrow(_priced, "conv_id long, part int, piece long, ahead array<long>, cost long"), "repair-prices")
    # a part holds a piece number once, so the two name a piece
    ends = cut.select("conv_id", "part", "piece", "kinds").join(priced.select("part", "piece", "ahead"), ["part", "piece"]).select("conv_id", "part", "piece", "kinds", "ahead")
    traced = ends.repartition(tasks, "part", "piece").mapInArrow(_traced, "conv_id long, part int, piece long, letters array<string>, exits array<long>")
    forth = traced.join(cut.select("part", "piece", "first", "last"), ["part", "piece"]).select("conv_id", "part", "piece", "letters", "exits", "first", "last")
    forth = forth.repartition(tasks, "conv_id").sortWithinPartitions(*place)
    chosen = settle(forth.mapInArrow(_chosen, "conv_id long, part int, piece long, number long, entry long, exit long, audit string, border long"), "repair-states")
    turns = known.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = chosen.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pieces"))
    facts = counts.join(turns.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).select(F.col("conv_id").alias("c"), "pieces", "gaps")
    slim = chosen.join(priced.select("part", "piece", "cost"), ["part", "piece"]).join(facts, F.col("conv_id").eqNullSafe(F.col("c")))
    whole = slim.drop("conv_id", "c").join(cut.drop("kinds", "matrix", "first", "last"), ["part", "piece"])
    return whole.mapInArrow(_rendered, PIECE)


def repaired(rows: DataFrame, row_limit: int = ROWS, byte_limit: int = BYTES) -> DataFrame:
    """Pieces of the repaired conversations of ``conv_id, turn, role, text``.

    ``conv_id``, ``piece`` of ``pieces``, the edits' initials ``audit``, the lines ``repaired``, and shares of ``gaps, blank, duplicate,
    truncated, illegal, cost``, whose sums over the pieces are the conversation's. One of up to ``row_limit`` rows is one piece.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    read = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    sizes = read.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = settle(sizes.filter((F.col("n") > row_limit) | (F.col("bytes") > byte_limit)).select(F.col("conv_id").alias("long_id")), "long-conversations")
    has_long = not long.isEmpty()
    read = read.withColumn("fault", _fault(F.col("text")))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = read.join(long, is_long, "left_anti") if has_long else read
    dealt = short.repartition(parallelism(rows), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    out = dealt.mapInArrow(_whole_conversations, PIECE)
    return out.unionAll(_in_pieces(read.join(long, is_long, "left_semi"), row_limit, byte_limit)) if has_long else out


def reports(pieces: DataFrame) -> DataFrame:
    """A row per conversation of ``repaired``: its counts, its audit, and the SHA-256 of its lines ``role:text``, joined by line feeds.

    The digest of a conversation in pieces is fed piece by piece in one task, as SHA-256 is sequential; that task holds one piece
    and the audit.
    """
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    one = pieces.filter("pieces = 1").select("conv_id", "gaps", *COUNTS, "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    names = ["conv_id", "gaps", *COUNTS, "audit", "repaired_sha256"]
    schema = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64())] + [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, sums, audit, digest, any_line = None, None, [], None, False

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, [conv_id, *sums, "".join(audit), digest.hexdigest()]))], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if digest is None or row["conv_id"] != conv_id:
                    if digest is not None:
                        yield closed()
                    conv_id, sums, audit, digest, any_line = row["conv_id"], [0] * (1 + len(COUNTS)), [], hashlib.sha256(), False
                sums = [a + row[name] for a, name in zip(sums, ("gaps", *COUNTS))]
                audit.append(row["audit"])
                for said in row["repaired"]:
                    digest.update(("\n" if any_line else "").encode() + f"{said['role']}:{said['text']}".encode())
                    any_line = True
        if digest is not None:
            yield closed()

    many = pieces.filter("pieces > 1").repartition(parallelism(pieces), "conv_id").sortWithinPartitions("conv_id", "piece")
    ddl = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return one.unionAll(many.select("conv_id", "gaps", *COUNTS, "audit", "repaired").mapInArrow(fed, ddl))


def repair_reports(convs: DataFrame, row_limit: int = ROWS, byte_limit: int = BYTES) -> DataFrame:
    """``reports`` of the damaged conversations, one row per original conversation, also where no row is left."""
    rows = damaged(convs)
    pieces = settle(repaired(rows, row_limit, byte_limit), "repaired")
    found = reports(pieces)
    ids = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    left = pieces.filter("piece = 0").select(F.col("conv_id").alias("left_id"))
    gone = ids.join(left, F.col("conv_id").eqNullSafe(F.col("left_id")), "left_anti")
    zeros = [F.lit(0).cast("long").alias(c) for c in ("gaps", *COUNTS)]
    return found.unionAll(gone.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
