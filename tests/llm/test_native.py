"""Mixing and line dedup against plain Python, and that their plans hold no Python."""

import contextlib
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import line_dedup as L
from parlance.llm import mixing as M


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def lines_brute(rows, width=3):
    windows = {}
    for number, (doc_id, text) in enumerate(rows):
        lines = [] if text is None else text.split("\n")
        for at in range(len(lines) - width + 1):
            windows.setdefault(tuple(lines[at : at + width]), []).append(((-1 if doc_id is None else doc_id), at, number))
    gone = {}
    for places in windows.values():
        for _, at, number in sorted(places)[1:]:
            gone.setdefault(number, set()).update(range(at, at + width))
    out = []
    for number, (doc_id, text) in enumerate(rows):
        lines, lost = ([] if text is None else text.split("\n")), gone.get(number, set())
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in lost)
        out.append((doc_id, kept, len(lines), len(lost)))
    return sorted(out, key=repr)


def test_lines_like_brute_force(spark):
    rng = random.Random(4)
    rows = [(i * 3 % 101, "\n".join(rng.choice(["a", "b", "", "long line " * 9, "é"]) for _ in range(rng.randrange(1, 14)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "x\nx\nx\nx\nx\nx"), (203, "a\nb"), (None, "q\nr\ns\nt"), (204, "0\nq\nr\ns\nt\n"), (205, "only\nthree\nlines")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, lines int").repartition(4)
    got = L.without_repeats(docs)
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr) == lines_brute(rows)
    assert got.columns == ["doc_id", "lines", "text", "n_lines", "n_removed"]
    assert L.without_repeats(docs.limit(0)).count() == 0


def test_equal_rows_are_one_document(spark):
    docs = spark.createDataFrame([(5, "a\nb\nc"), (5, "a\nb\nc"), (6, "a\nb\nc\nd")], "doc_id long, text string")
    got = sorted(map(tuple, L.without_repeats(docs).collect()))
    assert got == [(5, "a\nb\nc", 3, 0), (5, "a\nb\nc", 3, 0), (6, "d", 4, 3)]


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, f"text {i}", "big") for i in range(3000)] + [(5000 + i, "t", "small") for i in range(300)] + [(9000, None, None), (None, "y", "small"), (None, "y", "small")]
    return spark.createDataFrame([(a, b, c, 1.0) for a, b, c in rows], "doc_id long, text string, source string, rate double")


def test_rates_meet_the_weights(spark, sources):
    rates = {r.source: r.rate for r in M.source_rates(sources, {"big": 1.0, "small": 3.0}).collect()}
    sizes = {"big": sum(len(f"text {i}") + 1 for i in range(3000)), "small": 300 * 2 + 4}
    total = sum(sizes.values()) + 1
    assert rates[None] == 0 and math.isclose(rates["big"], total * 0.25 / sizes["big"]) and math.isclose(rates["small"], total * 0.75 / sizes["small"])


def test_copies_are_poisson(spark, sources):
    rates = spark.createDataFrame([("big", 0.7), ("small", 40.0)], "source string, rate double")
    mix = M.replicated(sources, rates)
    assert "Python" not in plan_of(mix) and "Arrow" not in plan_of(mix)
    rows = mix.collect()
    assert mix.columns == [*sources.columns, "mix_copy", "mix_order"] and all(r.rate == 1.0 for r in rows)
    counts = {}
    for r in rows:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    drawn = [counts.get(i, 0) for i in range(3000)]
    assert abs(sum(drawn) / 3000 - 0.7) < 0.06
    for k in range(4):
        assert abs(drawn.count(k) / 3000 - math.exp(-0.7) * 0.7**k / math.factorial(k)) < 0.03
    large = [counts.get(5000 + i, 0) for i in range(300)]
    mean = sum(large) / 300
    assert abs(mean - 40) < 1.5 and 25 < sum((x - mean) ** 2 for x in large) / 300 < 58
    again = sorted((str(r.doc_id), r.mix_copy, r.mix_order) for r in M.replicated(sources.repartition(7), rates).collect())
    assert again == sorted((str(r.doc_id), r.mix_copy, r.mix_order) for r in rows)


def test_mix_of_nothing(sources):
    assert M.mixed(sources.limit(0)).count() == 0
    assert M.mixed(sources, {"other": 1.0}).count() == 0


def test_any_column_names(spark, sources):
    names = ["mix_source", "mix_parts", "mix_below", "mix_count", "mix_copy", "mix_order", "dedup_key", "dedup_doc", "dedup_hash", "dedup_covered", "n_lines", "MIX_Source_"]
    docs = sources.select("doc_id", "text", "source", *[F.lit(n).alias(n) for n in names])
    mix = M.mixed(docs)
    assert sorted(mix.columns) == sorted(docs.columns) and mix.filter("mix_source != 'mix_source' or mix_count != 'mix_count'").count() == 0
    assert dict(mix.dtypes)["mix_copy"] == "int" and mix.count() == M.mixed(sources).count()
    got = L.without_repeats(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "n_removed"]) and got.filter("dedup_key = 'dedup_key' and n_lines >= 0").count() == docs.count()
