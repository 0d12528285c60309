"""WER, DER, attribution and suite totals: hand cases and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators.alignment import best_mapping, edit_counts
from parlance.plans import evals as ev

TURN = "case string, start double, end double, speaker string"


def wer(spark, ref, hyp):
    df = spark.createDataFrame([("c", ref, hyp)], "case string, reference string, hypothesis string")
    return ev.word_errors(df).first()


def test_words(spark):
    """Each edit by itself, all of them together, and what normalising makes equal."""
    base = "rain falls on the old harbour wall tonight".split()
    changed, longer, shorter = [*base[:3], "a", *base[4:]], [*base[:5], "quiet", *base[5:]], base[1:]
    for hyp, counts in ((changed, (1, 0, 0, 7)), (longer, (0, 1, 0, 8)), (shorter, (0, 0, 1, 7)), (base, (0, 0, 0, 8)), ([], (0, 0, 8, 0))):
        r = wer(spark, " ".join(base), " ".join(hyp))
        assert (r.substitutions, r.insertions, r.deletions, r.hits) == counts and r.wer == sum(counts[:3]) / 8
    assert wer(spark, "yes", " ".join(["yes"] + ["no"] * 4)).wer == 4.0
    assert wer(spark, "\n", "").wer == 0.0
    r = wer(spark, " ", "word")
    assert r.error == ev.EMPTY_REFERENCE and r.wer is None
    for a, b in (("Don\u2019t stop: now!", "don t stop now"), ("half ½", "HALF 1⁄2"), ("ｗｉｄｅ letters", "wide LETTERS"), ("again (×7)", "again")):
        assert wer(spark, a, b).wer == 0.0, (a, b)


def table(a, b):
    t = {}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if i == 0 or j == 0:
            t[i, j] = (i + j, 0, j, i, 0)
        elif a[i - 1] == b[j - 1]:
            c = t[i - 1, j - 1]
            t[i, j] = (*c[:4], c[4] + 1)
        else:
            moves = [(t[i - 1, j - 1], 1), (t[i - 1, j], 3), (t[i, j - 1], 2)]
            best = min(m[0][0] for m in moves)
            cell, at = next(m for m in moves if m[0][0] == best)
            cell = list(cell)
            cell[0] += 1
            cell[at] += 1
            t[i, j] = tuple(cell)
    return t[len(a), len(b)][1:]


def test_alignment_equals_a_full_table():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        assert edit_counts(a, b) == table(a, b)


def test_mapping_equals_all_permutations():
    rng = random.Random(2)
    for _ in range(200):
        refs, hyps = list("abcd")[: rng.randint(1, 4)], list("wxyz")[: rng.randint(1, 4)]
        overlap = {(r, h): float(rng.randint(0, 3)) for r in refs for h in hyps}
        few, many = (refs, hyps) if len(refs) <= len(hyps) else (hyps, refs)
        best, want = -1.0, {}
        for perm in itertools.permutations(many, len(few)):
            pairs = list(zip(few, perm)) if few is refs else [(r, h) for h, r in zip(few, perm)]
            score = sum(overlap[p] for p in pairs)
            if score > best:
                best, want = score, {r: h for r, h in pairs if overlap[r, h] > 0}
        assert best_mapping(refs, hyps, overlap) == want


@pytest.mark.parametrize("size", [7, 9, 40])
def test_mapping_is_exact_at_any_size(size):
    names = [f"{i:02d}" for i in range(size)]
    spare = {(f"r{n}", f"h{n}"): 0.0 for n in names}
    tempting = spare | {("r00", "h00"): 10.0, ("r00", "h01"): 9.0, ("r01", "h00"): 9.0}
    got = best_mapping([f"r{n}" for n in names], [f"h{n}" for n in names], tempting)
    assert got == {"r00": "h01", "r01": "h00"}


def test_alignment_equals_a_full_table_where_the_band_grows():
    rng = random.Random(3)
    for errors in (0.05, 0.9):
        a = [rng.choice("abcdefgh") for _ in range(400)]
        b = [w if rng.random() > errors else rng.choice("abcxyz") for w in a if rng.random() > errors / 4]
        assert edit_counts(a, b) == table(a, b)


def test_mapping_of_thousands_of_labels_by_their_overlaps():
    size = 3000
    refs, hyps = [f"r{i:04d}" for i in range(size)], [f"h{i:04d}" for i in range(size)]
    overlap = {}
    for i in range(0, size, 2):  # pairs where the greedy choice loses
        overlap |= {(refs[i], hyps[i]): 10.0, (refs[i], hyps[i + 1]): 9.0, (refs[i + 1], hyps[i]): 9.0}
    got = best_mapping(refs, hyps, overlap)
    assert got == {refs[i]: hyps[i + 1 if i % 2 == 0 else i - 1] for i in range(size)}


def test_long_texts_keep_their_counts():
    assert edit_counts(["a"], ["b"] * 3_000_000)[:3] == (1, 2_999_999, 0)


def der(spark, ref, hyp, collar=0.0, bucket=7.0):
    make = lambda rows: spark.createDataFrame([("c", float(s), float(e), p) for p, s, e in rows], TURN)
    return ev.diarization_errors(make(ref), make(hyp), collar=collar, bucket_s=bucket, chunk_s=5.0).first()


def der_by_ticks(ref, hyp):
    """Error parts in whole seconds, with the mapping that shares the most."""
    active = lambda turns, t: {p for p, s, e in turns if s <= t < e}
    last = max(e for _, _, e in ref + hyp)
    refs, hyps = sorted({p for p, _, _ in ref}), sorted({p for p, _, _ in hyp})
    ticks = [(active(ref, t), active(hyp, t)) for t in range(last)]
    fill = hyps + [None] * len(refs)
    best = max(sum(sum(1 for p in r if dict(zip(refs, perm)).get(p) in h) for r, h in ticks) for perm in set(itertools.permutations(fill, len(refs))))
    miss = sum(max(0, len(r) - len(h)) for r, h in ticks)
    false_alarm = sum(max(0, len(h) - len(r)) for r, h in ticks)
    confusion = sum(min(len(r), len(h)) for r, h in ticks) - best
    return miss, false_alarm, confusion, sum(len(r) for r, _ in ticks)


@pytest.mark.parametrize("seed", range(5))
def test_diarization_equals_ticks(spark, seed):
    rng = random.Random(seed)

    def turns(names):
        out = []
        for name in names:
            at = rng.randrange(0, 9)
            for _ in range(3):
                end = at + rng.randrange(1, 9)
                out.append((name, at, end))
                at = end + rng.randrange(1, 9)
        return out

    ref, hyp = turns("PQR"), turns("klm"[: 2 + seed % 2])
    r = der(spark, ref, hyp)
    miss, false_alarm, confusion, speech = der_by_ticks(ref, hyp)
    assert tuple(round(x, 6) for x in (r.miss_s, r.false_alarm_s, r.confusion_s, r.ref_speech_s)) == (miss, false_alarm, confusion, speech)
    assert abs(r.der - (miss + false_alarm + confusion) / speech) < 1e-9 and (r.ref_speakers, r.hyp_speakers) == (3, len({p for p, _, _ in hyp}))


def test_collar_forgives_shifted_borders(spark):
    r = der(spark, [("P", 2, 8), ("Q", 11, 16)], [("k", 2.2, 7.9), ("l", 11.1, 16.2)], collar=0.4)
    assert r.der == 0.0 and round(r.ref_speech_s, 9) == 11 - 4 * 0.4


def test_unscoreable_cases_are_error_rows(spark):
    ref = spark.createDataFrame([("tiny", 0.0, 0.3, "A"), ("none", 1.0, 1.0, "A")], TURN)
    hyp = spark.createDataFrame([("tiny", 0.0, 0.3, "x")], TURN)
    found = {r.case: r.error for r in ev.diarization_errors(ref, hyp, collar=0.25).collect()}
    assert found == {"tiny": ev.NOTHING_SCORED, "none": ev.NO_SPEECH}


def test_attribution_and_totals(spark):
    ref = spark.createDataFrame([("c", 0.0, 10.0, "USER"), ("d", 0.0, 5.0, "S1")], TURN)
    hyp = spark.createDataFrame([("c", 0.0, 8.0, "USER"), ("d", 0.0, 5.0, "S1")], TURN)
    rows = ev.wearer_attribution(ref, hyp).collect()
    assert [(r.case, r.user_acc, r.ref_user_s) for r in rows] == [("c", 0.8, 10.0)]
    pairs = spark.createDataFrame(
        [("c", True, "a b", "a c"), ("d", True, "a b", "a b"), ("e", False, "", "x")],
        "case string, verified boolean, reference string, hypothesis string",
    )
    suite = ev.suite(pairs, ref, hyp)
    totals = ev.suite_totals(suite).first()
    assert (totals.cases, totals.failed, totals.wer, totals.ref_words, totals.user_acc) == (3, 1, 0.25, 4, 0.8)


def test_nothing_to_score_is_null(spark):
    pairs = spark.createDataFrame([("e", False, "", "x")], "case string, verified boolean, reference string, hypothesis string")
    none = spark.createDataFrame([], TURN)
    totals = ev.suite_totals(ev.suite(pairs, none, none)).first()
    assert (totals.cases, totals.failed, totals.wer, totals.der, totals.user_acc) == (1, 1, None, None, None)


def test_fingerprint(spark):
    def of(sql):
        return spark.sql(f"SELECT {sql} AS m").select(ev.fingerprint(F.col("m"))).first()[0]

    assert of("map('a', '1', 'b', '2')") == of("map('b', '2', 'a', '1')") != of("map('a', '1', 'b', '3')")


def test_case_drafts(spark):
    sessions = spark.sql(
        """SELECT * FROM VALUES ('11111111-x', TIMESTAMP '2024-05-01 10:00:00', '/a', 'one\\n\\ntwo'),
        ('22222222-x', TIMESTAMP '2024-05-01 10:00:00', NULL, 'x'), ('33333333-x', TIMESTAMP '2024-05-01 10:00:00', '/a', NULL),
        ('44444444-x', TIMESTAMP '2024-05-01 10:00:00', '/a', ' ') AS t(session_id, started_at, audio_path, text)"""
    )
    segments = spark.createDataFrame([], "session_id string, pos int, start double, end double, text string, speaker string")
    drafts, refused = ev.case_drafts(sessions, segments)
    assert [(r.case, r.text) for r in drafts.orderBy("pos").collect()] == [("2024-05-01-11111111", "one"), ("2024-05-01-11111111", "two")]
    assert sorted(r.reason for r in refused.collect()) == ["audio is gone", "no transcript yet", "transcript is empty"]


def test_pairs_aligned_together_equal_single_ones(monkeypatch):
    import random

    from parlance.operators import alignment as al

    rng = random.Random(5)
    word = lambda kinds: str(rng.randrange(kinds))
    pairs = []
    for _ in range(300):
        kinds, n, m = rng.choice([2, 5, 200]), rng.choice([0, 1, 3, 20, 60]), rng.choice([0, 1, 2, 20, 55])
        said = [word(kinds) for _ in range(rng.randint(0, n))]
        pairs.append((said, [word(kinds) for _ in range(rng.randint(0, m))] if rng.random() < 0.7 else [w for w in said if rng.random() < 0.9] + ["z"]))
    want = [al.edit_counts(r, h) for r, h in pairs]
    single = []
    monkeypatch.setattr(al, "edit_counts", lambda r, h: single.append((r, h)) or (0, 0, 0, 0))
    assert al.edit_counts_of(pairs) == want and not single
    monkeypatch.setattr(al, "TOGETHER_CELLS", 64)
    assert al.edit_counts_of(pairs) == want and al.edit_counts_of([]) == []
    monkeypatch.undo()
    monkeypatch.setattr(al, "TOGETHER_WORDS", 10)
    assert al.edit_counts_of(pairs) == want


def test_alike_pairs_are_aligned_only_where_they_differ(monkeypatch):
    from parlance.operators import alignment as al

    rng = random.Random(8)
    handed = []
    whole, together = al.edit_counts, al._together
    monkeypatch.setattr(al, "edit_counts", lambda r, h: handed.append(len(r) + len(h)) or whole(r, h))
    monkeypatch.setattr(al, "_together", lambda pairs, *band: handed.extend(len(r) + len(h) for r, h in pairs) or together(pairs, *band))
    said = [str(rng.randrange(50)) for _ in range(2000)]
    pairs = [(said, ["oui", *said]), (said, said), (said, [*said, "oui"]), (said[:900] + ["a"] + said[900:], said[:900] + ["b"] + said[900:])]
    assert al.edit_counts_of(pairs) == [(0, 1, 0, 2000), (0, 0, 0, 2000), (0, 1, 0, 2000), (1, 0, 0, 2000)]
    assert sum(handed) <= 2
    some = []
    for _ in range(150):  # common words at both ends, few and many errors between, beyond the narrow band too
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, n))] for n in (30, 30))
        head, tail = ([rng.choice("abc") for _ in range(rng.randint(0, 4))] for _ in "ht")
        some.append((head + a + tail, head + b + tail))
    monkeypatch.setattr(al, "TOGETHER_BAND", 3)
    assert al.edit_counts_of(some) == [table(a, b) for a, b in some]


def test_cases_are_mapped_without_a_group_each(spark):
    rows = [(case, ref, hyp, 1.0 + (ref == hyp)) for case in range(500) for ref in "ab" for hyp in "ab"]
    overlap = spark.createDataFrame(rows, "case long, ref string, hyp string, shared_s double")
    sides = spark.createDataFrame([(case, side, p) for case in range(500) for side in "rh" for p in "ab"], "case long, side string, speaker string")
    mapped = ev.label_mapping(sides, overlap)
    assert sorted(tuple(r) for r in mapped.collect()) == [(case, p, p) for case in range(500) for p in "ab"]
    assert "FlatMapGroups" not in mapped._jdf.queryExecution().toString()


def test_cells_equal_ticks_whatever_the_batches(spark, monkeypatch):
    rng = random.Random(9)
    sides = [(side, case, f"{side}{p}", float(a), float(a + rng.randint(1, 9))) for case in range(6) for side in "rh" for p in range(3) for a in (rng.randint(0, 9), rng.randint(20, 40))]
    zones = [(case, float(a), float(a + 2)) for case in range(6) for a in (3, 8, 25)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        both = spark.createDataFrame(sides, "side string, case long, speaker string, start double, end double")
        cells = ev.active_cells(both, spark.createDataFrame(zones, "case long, start double, end double"), 7.0)
        got = sorted((r.case, t, r.side, r.speaker) for r in cells.collect() for t in range(int(r.lo), int(r.lo + r.d)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    dead = {(case, t) for case, a, b in zones for t in range(int(a), int(b))}
    assert got == sorted((case, t, side, p) for side, case, p, a, b in sides for t in range(int(a), int(b)) if (case, t) not in dead)
    assert "Join" not in cells._jdf.queryExecution().toString()
