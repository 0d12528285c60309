"""Fusion against plain Python from the same text evidence, and odd pages."""

import math

import pytest
from pyspark.sql import functions as F

from parlance.llm import language as G

EN = "the quick brown fox jumps over the lazy dog and runs through the forest with the others while they watch "
DE = "der schnelle braune Fuchs springt über den faulen Hund und läuft durch den Wald während die anderen zusehen "


def page(text, lang=None):
    return f"<html{f' lang={chr(34)}{lang}{chr(34)}' if lang else ''}><body><article><p>{text}</p></article></body></html>"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, (EN if i % 2 else DE) * (1 + i % 3), "en" if i % 2 else "de") for i in range(30)] + [(99, None, "fr"), (98, "x", None)], "doc_id long, text string, lang string")
    pages = [(i, f"https://www.zeitung.de/{i}", page(DE, "de-DE")) for i in range(20)]
    pages += [(100 + i, f"http://news.example.com:80/{i}", page(EN, "en")) for i in range(20)]
    pages += [(200, "https://www.zeitung.de/x", page("", None)), (201, "http://news.example.com", page("", None)), (202, None, None), (203, "not an address", page(EN)), (204, "http://other.example.com/", page("")), (205, "http://x.org", page("", "de"))]
    return spark.createDataFrame([(a, b, c, "lang") for a, b, c in pages], "page_id long, url string, html string, lang string"), docs


def brute(rows, langs):
    """The same sums, in dictionaries."""
    def normal(logs):
        top = max(logs)
        raised = [math.exp(x - top) for x in logs]
        return [x / sum(raised) for x in raised]

    posts = [[x if x >= G.LEAST_SHARE else 0.0 for x in normal(r.likelihoods)] for r in rows]
    n = len(langs)
    total = [sum(p[i] for p in posts) for i in range(n)]
    base = [(t + 1) / (sum(total) + n) for t in total]
    sums = {by: {} for by in ("declared", "suffix", "domain", "host")}
    for r, p in zip(rows, posts):
        for by, table in sums.items():
            if r[by] is not None:
                table[r[by]] = [a + b for a, b in zip(table.get(r[by], [0.0] * n), p)]
    out = {}
    for r, p in zip(rows, posts):
        logs = []
        for i in range(n):
            prior = base[i]
            for by in ("domain", "host"):
                if r[by] is not None:
                    own = sums[by][r[by]]
                    prior = (own[i] - p[i] + G.SMOOTHING * prior) / (sum(own) - sum(p) + G.SMOOTHING)
            score = r.likelihoods[i] + math.log(prior)
            for by in ("declared", "suffix"):
                if r[by] is not None:
                    score += math.log((sums[by][r[by]][i] - p[i] + G.UNSEEN) / (total[i] + G.UNSEEN * (len(sums[by]) + 1)))
            logs.append(score)
        final = normal(logs)
        out[r.page_id] = (langs[final.index(max(final))], max(final))
    return out


def test_like_brute_force(tables):
    pages, docs = tables
    langs, model = G.text_model(docs)
    assert langs == ["de", "en"]
    evidence = G.text_evidence(pages, langs, model, "page_id", "url", "html").cache()
    got = {r.page_id: r for r in G.fused(evidence, langs).collect()}
    want = brute(evidence.collect(), langs)
    assert set(got) == set(want)
    for key, (lang, probability) in want.items():
        assert got[key].lang == lang and abs(got[key].probability - probability) < 1e-9


def test_evidence_decides(tables):
    got = {r.page_id: r for r in G.page_languages(*tables).collect()}
    assert all(got[i].lang == "de" for i in range(20)) and all(got[100 + i].lang == "en" for i in range(20))
    assert got[200].lang == "de" and got[201].lang == "en" and got[203].lang == "en" and got[204].lang == "en" and got[205].lang == "de"
    assert got[200].text_lang is None and got[202].suffix is None and got[5].declared == "de" and got[100].host == "news.example.com"


def test_empty_tables(tables):
    pages, docs = tables
    assert G.page_languages(pages.limit(0), docs).count() == 0
    none = G.page_languages(pages, docs.limit(0))
    assert none.count() == pages.count() and none.filter(F.col("lang").isNotNull()).count() == 0


def test_given_pages(spark):
    folder = "/root/testdata/sf0.01"
    got = G.page_languages(*(spark.read.parquet(f"{folder}/{n}.parquet") for n in ("pages", "documents"))).collect()
    assert len(got) == 250 and sum(r.lang == r.declared for r in got) >= 248
