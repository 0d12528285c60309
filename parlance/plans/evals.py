"""Scoring of transcripts and speaker labels: WER, DER, wearer attribution, suites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.batches import slices
from parlance.functions.text import fingerprint, string_or_null, strip, tokens  # noqa: F401
from parlance.operators.alignment import best_mapping, edit_counts_udf
from parlance.operators.intervals import cut_at_buckets, no_score_collars, turns, union_intervals, valid
from parlance.operators.overlap import intersection_seconds
from parlance.plans.transcripts import WEARER, editing_rows
from parlance.session import parallelism, settle

COLLAR_S = 0.25
CASE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,80}$"  # fixed value: allowed case names
EMPTY_REFERENCE = "reference text has no words but the hypothesis has"
NO_SPEECH = "reference has no valid speech turns"
NOTHING_SCORED = "no scoreable reference speech"


def word_errors(pairs: DataFrame) -> DataFrame:
    """WER counts per row of ``case, reference, hypothesis``; ``error`` marks an empty reference."""
    words = pairs.withColumns({"r": tokens(F.col("reference")), "h": tokens(F.col("hypothesis"))})
    # The alignment is the cost; spread the pairs over all tasks whatever their bytes.
    counted = words.repartition(parallelism(pairs), F.xxhash64("case", "reference")).withColumn("c", edit_counts_udf()("r", "h"))
    n_ref, n_hyp = F.size("r").cast("long"), F.size("h").cast("long")
    wrong = (n_ref == 0) & (n_hyp > 0)
    errors = F.col("c.substitutions") + F.col("c.insertions") + F.col("c.deletions")
    keep = lambda c: F.when(~wrong, c)
    return counted.select(
        *[c for c in pairs.columns if c not in ("reference", "hypothesis")],
        F.when(n_ref > 0, errors / n_ref).when(n_hyp == 0, F.lit(0.0)).alias("wer"),
        *[keep(F.col(f"c.{x}")).alias(x) for x in ("substitutions", "insertions", "deletions", "hits")],
        n_ref.alias("ref_words"),
        n_hyp.alias("hyp_words"),
        F.when(wrong, F.lit(EMPTY_REFERENCE)).alias("error"),
    )


def hypothesis_text(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The text to score: non-blank segment texts in order, else the transcript's own text.

    Words of one case are one side of one alignment, so they belong on one row.
    """
    said = string_or_null(F.col("text"))
    joined = segments.filter(said.isNotNull()).groupBy("case").agg(
        F.concat_ws(
            " ", F.transform(F.array_sort(F.collect_list(F.struct("pos", strip(F.col("text")).alias("t")))), lambda s: s["t"])
        ).alias("joined")
    )
    return transcripts.join(joined, "case", "left").select("case", F.coalesce("joined", "text").alias("hypothesis"))


def merged_sides(ref_turns: DataFrame, hyp_turns: DataFrame, chunk_s: float = 3600.0) -> DataFrame:
    """Both labellings as one table of merged intervals: ``side`` (``r``, ``h``), case, speaker, times."""
    tag = lambda df, side: valid(df).select(F.lit(side).alias("side"), "case", "speaker", "start", "end")
    both = tag(ref_turns, "r").unionByName(tag(hyp_turns, "h"))
    return settle(union_intervals(both, ["side", "case", "speaker"], chunk_s=chunk_s), "sides")


def side_of(sides: DataFrame, side: str) -> DataFrame:
    return sides.filter(F.col("side") == side).drop("side")


def active_cells(sides: DataFrame, zones: DataFrame | None, bucket_s: float) -> DataFrame:
    """Speakers active in each scored elementary interval: ``case, bucket, lo, d, side, speaker``.

    Everything is cut at bucket borders, so a long case is many independent buckets. A bucket's pieces meet in one task, where
    sorted points number its cells; its rows are given on a part at a time.
    """
    rows = sides
    if zones is not None:
        excluded = zones.select(F.lit("x").alias("side"), "case", F.lit("").alias("speaker"), "start", "end")
        rows = sides.unionByName(excluded)
    key = ["case", "bucket"]
    pieces = cut_at_buckets(rows, bucket_s).select(*key, "side", "speaker", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = f"case {kinds['case']}, bucket {kinds['bucket']}, lo double, d double, side string, speaker {kinds['speaker']}"

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []  # pieces of the last bucket, which the next batch may go on with
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if waiting and all(table[k][0] == waiting[-1][k][0] == table[k][-1] for k in key):
                waiting.append(table)
                continue
            table = pa.concat_tables([*waiting, table]).combine_chunks()
            last = pc.and_(*(pc.equal(table[k], table[k][-1]) for k in key)).to_numpy()
            whole = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            yield from _cells_of(table.slice(0, whole))
            waiting = [table.slice(whole)]
        if waiting:
            yield from _cells_of(pa.concat_tables(waiting).combine_chunks())

    return pieces.repartition(parallelism(pieces), *key).sortWithinPartitions(*key).mapInArrow(cells, schema)


#: Rows that a task gives on at a time.
CELL_ROWS = 1 << 15


def _cells_of(pieces: pa.Table) -> Iterator[pa.RecordBatch]:
    """The scored cells of whole buckets, whose pieces follow each other: a row per cell and piece active in it.

    Pieces begin and end on points of their bucket, so a piece is active in exactly the cells between the numbers of its points.
    """
    rows = pieces.num_rows
    if rows == 0:
        return
    border = np.zeros(rows, dtype=bool)
    for name in ("case", "bucket"):
        border[1:] |= pc.not_equal(pieces[name][1:], pieces[name][:-1]).to_numpy()
    group = np.cumsum(border)
    start, end = pieces["start"].to_numpy(), pieces["end"].to_numpy()
    of, at = np.concatenate([group, group]), np.concatenate([start, end])
    order = np.lexsort((at, of))
    new = np.ones(2 * rows, dtype=bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (at[order][1:] != at[order][:-1])
    number = np.empty(2 * rows, dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first, last = number[:rows], number[rows:]
    lo = at[order][new]
    width = np.append(np.diff(lo), 0.0)  # the cell behind a bucket's last point is no piece's
    excluded = pc.equal(pieces["side"], "x").to_numpy()
    opens = np.zeros(len(lo) + 1, dtype=np.int64)
    some = excluded & (last > first)
    np.add.at(opens, first[some], 1)
    np.add.at(opens, last[some], -1)
    scored = (np.cumsum(opens[:-1]) == 0) & (width > 1e-9)
    lengths = np.where(excluded, 0, np.maximum(last - first, 0))
    ends = np.cumsum(lengths)
    for begin in range(0, int(ends[-1]), CELL_ROWS):
        places = np.arange(begin, min(begin + CELL_ROWS, int(ends[-1])))
        piece = np.searchsorted(ends, places, side="right")
        cell = first[piece] + places - (ends[piece] - lengths[piece])
        piece, cell = piece[scored[cell]], cell[scored[cell]]
        if len(piece):
            taken = pieces.select(["case", "bucket", "side", "speaker"]).take(pa.array(piece))
            columns = [taken["case"], taken["bucket"], pa.array(lo[cell]), pa.array(width[cell]), taken["side"], taken["speaker"]]
            yield from pa.table(columns, names=["case", "bucket", "lo", "d", "side", "speaker"]).combine_chunks().to_batches()


def speech_totals(cells: DataFrame) -> DataFrame:
    """Scored seconds per case: reference speech, missed, false and paired time."""
    n = lambda side: F.count_if(F.col("side") == side)
    counts = cells.groupBy("case", "bucket", "lo").agg(
        F.max("d").alias("d"), n("r").alias("n_ref"), n("h").alias("n_hyp")
    )
    n_ref, n_hyp, zero = F.col("n_ref"), F.col("n_hyp"), F.lit(0)
    return counts.groupBy("case").agg(
        F.sum(F.col("d") * n_ref).alias("ref_speech_s"),
        F.sum(F.col("d") * F.greatest(zero, n_ref - n_hyp)).alias("miss_s"),
        F.sum(F.col("d") * F.greatest(zero, n_hyp - n_ref)).alias("false_alarm_s"),
        F.sum(F.col("d") * F.least(n_ref, n_hyp)).alias("paired_s"),
    )


def co_active(cells: DataFrame) -> DataFrame:
    """Seconds in which a reference and a hypothesis speaker are both active."""
    key = ["case", "bucket", "lo"]
    ref = cells.filter("side = 'r'").select(*key, "d", F.col("speaker").alias("ref"))
    hyp = cells.filter("side = 'h'").select(*key, F.col("speaker").alias("hyp"))
    return ref.join(hyp, key).groupBy("case", "ref", "hyp").agg(F.sum("d").alias("shared_s"))


def label_mapping(sides: DataFrame, overlap: DataFrame) -> DataFrame:
    """Best one-to-one mapping per case, over its matrix of summed overlaps.

    A case holds one row per label and per pair of labels that ever speak together.
    """
    labels = sides.select("case", "side", "speaker").distinct()
    name = lambda side: F.when(F.col("side") == side, F.col("speaker"))
    rows = overlap.select("case", "ref", "hyp", "shared_s").unionByName(
        labels.select("case", name("r").alias("ref"), name("h").alias("hyp"), F.lit(None).cast("double").alias("shared_s"))
    )
    schema = overlap.select("case", "ref", "hyp").schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # cases are mostly a few rows: read as runs of sorted rows they cost their rows, not an Arrow stream each
        key, refs, hyps, shared = None, set(), set(), {}
        found: list[tuple] = []

        def close() -> None:
            if refs or hyps:
                found.extend((key, *pair) for pair in best_mapping(sorted(refs), sorted(hyps), shared).items())

        for batch in batches:
            for part in slices(batch, 4096):
                for case, ref, hyp, seconds in zip(*(c.to_pylist() for c in part.columns)):
                    if case != key:
                        close()
                        key, refs, hyps, shared = case, set(), set(), {}
                    if ref is not None:
                        refs.add(ref)
                    if hyp is not None:
                        hyps.add(hyp)
                    if ref is not None and hyp is not None:
                        shared[ref, hyp] = seconds
            yield of(found, batch)
            found.clear()
        if key is not None or refs or hyps:
            close()
            yield of(found, batch)

    def of(found: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        names = ["case", "ref", "hyp"]
        columns = zip(*found) if found else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, like.schema.field(n).type) for c, n in zip(columns, names)], names=names)

    return rows.repartition(parallelism(rows), "case").sortWithinPartitions("case").mapInArrow(assign, schema)


def diarization_errors(
    ref_turns: DataFrame,
    hyp_turns: DataFrame,
    cases: DataFrame | None = None,
    collar: float = COLLAR_S,
    bucket_s: float = 300.0,
    chunk_s: float = 3600.0,
) -> DataFrame:
    """DER per case of ``case, start, end, speaker`` turns.

    ``cases`` lists the cases that must appear; those that cannot be scored get an ``error``.
    """
    wanted = (cases if cases is not None else ref_turns).select("case").distinct()
    return errors_of_sides(merged_sides(ref_turns, hyp_turns, chunk_s), wanted, collar, bucket_s, chunk_s)


def errors_of_sides(
    sides: DataFrame, cases: DataFrame, collar: float, bucket_s: float, chunk_s: float
) -> DataFrame:
    """DER per case from merged intervals."""
    zones = no_score_collars(side_of(sides, "r"), ["case"], collar, chunk_s) if collar > 0 else None
    cells = settle(active_cells(sides, zones, bucket_s), "cells")
    totals = speech_totals(cells)
    overlap = settle(co_active(cells), "overlap")
    # Time in which a mapped pair is active together is exactly its summed overlap.
    correct = (
        overlap.join(label_mapping(sides, overlap), ["case", "ref", "hyp"])
        .groupBy("case")
        .agg(F.sum("shared_s").alias("correct_s"))
    )
    named = lambda side: F.countDistinct(F.when(F.col("side") == side, F.col("speaker")))
    speakers = sides.groupBy("case").agg(named("r").alias("ref_speakers"), named("h").alias("hyp_speakers"))
    rows = cases.join(speakers, "case", "left").join(totals, "case", "left").join(correct, "case", "left")
    has_ref = F.coalesce(F.col("ref_speakers") > 0, F.lit(False))
    scored = has_ref & F.coalesce(F.col("ref_speech_s") > 0, F.lit(False))
    confusion = F.col("paired_s") - F.coalesce("correct_s", F.lit(0.0))
    keep = lambda c: F.when(scored, c)
    return rows.select(
        "case",
        keep((F.col("miss_s") + F.col("false_alarm_s") + confusion) / F.col("ref_speech_s")).alias("der"),
        keep(F.col("miss_s")).alias("miss_s"),
        keep(F.col("false_alarm_s")).alias("false_alarm_s"),
        keep(confusion).alias("confusion_s"),
        keep(F.col("ref_speech_s")).alias("ref_speech_s"),
        keep(F.col("ref_speakers")).alias("ref_speakers"),
        keep(F.col("hyp_speakers")).alias("hyp_speakers"),
        F.when(~has_ref, F.lit(NO_SPEECH)).when(~scored, F.lit(NOTHING_SCORED)).alias("error"),
    )


def wearer_attribution(
    ref_turns: DataFrame, hyp_turns: DataFrame, label: str = WEARER, bucket_s: float = 300.0, chunk_s: float = 3600.0
) -> DataFrame:
    """Share of the wearer's reference speech that the hypothesis also gives to the wearer."""
    mine = lambda df: df.filter(F.col("speaker") == label)
    return attribution_of_sides(merged_sides(mine(ref_turns), mine(hyp_turns), chunk_s), label, bucket_s)


def attribution_of_sides(sides: DataFrame, label: str, bucket_s: float) -> DataFrame:
    """Wearer attribution per case from merged intervals."""
    mine = sides.filter(F.col("speaker") == label)
    ref, hyp = side_of(mine, "r"), side_of(mine, "h")
    hit = intersection_seconds(ref, hyp, ["case"], bucket_s)
    total = ref.groupBy("case").agg(F.sum(F.col("end") - F.col("start")).alias("ref_user_s"))
    return total.join(hit, "case", "left").select(
        "case", (F.coalesce("shared_s", F.lit(0.0)) / F.col("ref_user_s")).alias("user_acc"), "ref_user_s"
    )


def suite(
    pairs: DataFrame, ref_segments: DataFrame, hyp_segments: DataFrame, collar: float = COLLAR_S, bucket_s: float = 300.0,
    gap_tolerance_s: float = 1.0, chunk_s: float = 3600.0,
) -> DataFrame:
    """One metrics row per case: WER for all, DER and attribution where labels exist.

    ``pairs``: ``case, verified, reference, hypothesis``; segments: ``case, start, end, speaker``.
    """
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "case", "start", "end", "speaker")
    both = tag(ref_segments, "r").unionByName(tag(hyp_segments, "h"))
    folded = settle(turns(both, ["side", "case"], gap_tolerance_s, chunk_s), "turns")
    sides = merged_sides(side_of(folded, "r"), side_of(folded, "h"), chunk_s)
    labelled = side_of(folded, "r").select("case").distinct()
    words = word_errors(pairs).withColumnRenamed("error", "wer_error")
    der = errors_of_sides(sides, labelled, collar, bucket_s, chunk_s).withColumnRenamed("error", "der_error")
    user = attribution_of_sides(sides, WEARER, bucket_s)
    return (
        words.join(der, "case", "left")
        .join(user, "case", "left")
        .withColumn("error", F.coalesce("wer_error", "der_error"))
        .drop("wer_error", "der_error")
    )


def suite_totals(rows: DataFrame) -> DataFrame:
    """Micro-averages over the cases without an error; a part without a denominator is null."""
    ok = F.col("error").isNull()
    errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    wrong_s = F.col("miss_s") + F.col("false_alarm_s") + F.col("confusion_s")
    positive = lambda c: F.when(c > 0, c)
    sums = rows.agg(
        F.count("*").alias("cases"),
        F.count_if(~ok).alias("failed"),
        F.sum(F.when(ok, errors)).alias("errors"),
        F.sum(F.when(ok, F.col("ref_words"))).alias("ref_words"),
        F.sum(F.when(ok, wrong_s)).alias("wrong_s"),
        F.sum(F.when(ok, F.col("ref_speech_s"))).alias("ref_speech_s"),
        F.sum(F.when(ok, F.col("user_acc") * F.col("ref_user_s"))).alias("user_hit_s"),
        F.sum(F.when(ok, F.col("ref_user_s"))).alias("ref_user_s"),
    )
    return sums.select(
        "cases",
        "failed",
        (F.col("errors") / positive(F.col("ref_words"))).alias("wer"),
        positive(F.col("ref_words")).alias("ref_words"),
        (F.col("wrong_s") / positive(F.col("ref_speech_s"))).alias("der"),
        positive(F.col("ref_speech_s")).alias("ref_speech_s"),
        (F.col("user_hit_s") / positive(F.col("ref_user_s"))).alias("user_acc"),
    )


def valid_case_name(name: Column) -> Column:
    return name.rlike(CASE_NAME)


def default_case_name(started_at: Column, session_id: Column) -> Column:
    return F.concat(F.date_format(started_at, "yyyy-MM-dd"), F.lit("-"), F.substring(session_id, 1, 8))


def unknown_cases(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.select("case").distinct().join(known, "case", "left_anti")


def unverified(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.coalesce("verified", F.lit(False)))


def reusable(cases: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached hypotheses with the current fingerprint, and the cases to transcribe again.

    Both sides hold ``case, fingerprint``.
    """
    keys = ["case", "fingerprint"]
    return cases.join(cache, keys), cases.join(cache, keys, "left_anti")


def known_names(speakers: DataFrame, mentions: DataFrame, limit: int = 15) -> DataFrame:
    """Names for the vocabulary prompt: named speakers first, then the most mentioned."""
    own = speakers.filter(string_or_null(F.col("name")).isNotNull()).groupBy("name").agg(
        F.min("created_at").alias("at")
    ).select("name", F.lit(0).alias("part"), F.unix_micros("at").alias("ord"))
    heard = mentions.groupBy("name").agg(F.count("*").alias("n"), F.min("mentioned_at").alias("at")).select(
        "name", F.lit(1).alias("part"), (-F.col("n")).alias("ord")
    )
    first = own.unionByName(heard).groupBy("name").agg(F.min(F.struct("part", "ord")).alias("at"))
    return first.orderBy("at.part", "at.ord", "name").limit(limit).select("name", "at.part", "at.ord")


def vocabulary_prompt(base: str, names: DataFrame) -> DataFrame:
    """The prompt text of the known names (at most ``limit`` of them) after the configured one."""
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("part", "ord", "name"))), lambda r: r["name"]
    )
    prefix = base.strip()
    return names.agg(listed.alias("names")).select(
        F.when(F.size("names") == 0, F.lit(prefix))
        .otherwise(F.concat(F.lit(prefix + " " if prefix else ""), F.array_join("names", ", "), F.lit(".")))
        .alias("prompt")
    )


def spoken_language(configured: Column, detected: Column) -> Column:
    """The configured language; for ``auto`` the detected one, else ``auto``."""
    return F.when(configured != "auto", configured).otherwise(
        F.coalesce(F.nullif(detected, F.lit("")), F.lit("auto"))
    )


def case_drafts(sessions: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Editing rows of new cases, and the sessions that cannot become one with the reason.

    ``sessions``: ``session_id, started_at, audio_path, text`` (the latest transcript's).
    """
    named = sessions.withColumn(
        "case", default_case_name(F.col("started_at"), F.col("session_id").cast("string"))
    )
    reason = (
        F.when(F.col("audio_path").isNull(), "audio is gone")
        .when(F.col("text").isNull(), "no transcript yet")
        .when(~valid_case_name(F.col("case")), "bad case name")
    )
    usable = named.filter(reason.isNull())
    rows = editing_rows(segments, usable.select("session_id", "text")).join(
        usable.select("session_id", "case"), "session_id"
    )
    empty = usable.join(rows.select("session_id").distinct(), "session_id", "left_anti").withColumn(
        "reason", F.lit("transcript is empty")
    )
    refused = named.withColumn("reason", reason).filter(F.col("reason").isNotNull()).unionByName(empty)
    return rows, refused.select("session_id", "case", "reason")
