"""Language of web pages by Bayesian fusion of evidence.

* Text: a naive Bayes model of hashed character trigrams, counted per language over all labelled documents, gives
  each page's main text a log likelihood per language (divided by ``DEPENDENCE``, since trigrams overlap).
* Declared markup language and address suffix: how often each goes with each language, summed over all pages
  with the text's posterior as weight.
* Host: a prior smoothed along host <- registered domain <- all pages, from the same sums, without the page's own share.

The posterior is the normalised product. Everything a page needs from others is a grouped sum: a host with a third
of all pages arrives as one row per map task.

Cases: a page without text, declaration, suffix or host gets nothing from that evidence; documents without
language or text are not counted; without any labelled document the language is null and its probability 0; repeated
pages are judged alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import main_text
from parlance.llm import words as W
from parlance.session import settle

BUCKETS = 1 << 16
DEPENDENCE = 4.0
#: Weight of the wider level in a host's prior, in pages; and of an unseen value in a table of evidence.
SMOOTHING, UNSEEN = 10.0, 0.5
#: Posterior shares below this are left out of the sums.
LEAST_SHARE = 1e-3


def trigram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and each text's first one."""
    points = [np.frombuffer((" " + " ".join(t.lower().split()) + " ").encode("utf-32-le"), dtype=np.uint32) for t in texts]
    grams = []
    for p in points:
        if len(p) < 3:
            grams.append(np.zeros(0, dtype=np.int64))
            continue
        with np.errstate(over="ignore"):
            code = p[:-2].astype(np.uint64) * np.uint64(0x1F123BB5) + p[1:-1].astype(np.uint64) * np.uint64(0x2545F491) + p[2:].astype(np.uint64) * np.uint64(0x9E3779B1)
        grams.append((W.mix(code) >> np.uint64(48)).astype(np.int64))
    return (np.concatenate(grams) if grams else np.zeros(0, dtype=np.int64)), np.cumsum([0] + [len(g) for g in grams])


def trigram_table(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, bucket, seen`` over all whole labelled texts; at most 65,536 rows a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["lang", "bucket", "seen"])
            sums.clear()

        for whole in batches:
            for batch in W.slices(whole, "text"):
                langs = batch.column(1).to_pylist()
                grams, first = trigram_buckets(batch.column(0).to_pylist())
                label = np.repeat(np.arange(len(langs)), np.diff(first))
                for lang in set(langs):
                    rows = np.array([x == lang for x in langs])
                    total = np.bincount(grams[rows[label]], minlength=BUCKETS)
                    sums[lang] = sums[lang] + total if lang in sums else total
                if len(sums) > 64:
                    yield from flushed()
        yield from flushed()

    read = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return read.mapInArrow(count, "lang string, bucket int, seen long").groupBy("lang", "bucket").agg(F.sum("seen").alias("seen"))


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each bucket in each of them."""
    rows = trigram_table(docs, text_col, lang_col).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    number = {lang: i for i, lang in enumerate(langs)}
    table = np.full((len(langs), BUCKETS), 0.5)
    if rows.num_rows:
        at = np.array([number[x] for x in rows.column("lang").to_pylist()])
        table[at, rows.column("bucket").to_numpy()] += rows.column("seen").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain (its last two labels) and suffix (its last); null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(F.length(host) > 0, host)
    labels = F.split(host, r"\.")
    return host, F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)), F.element_at(labels, -1)


def text_evidence(pages: DataFrame, langs: list[str], model: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, url, declared, suffix, domain, host, likelihoods`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    host, domain, suffix = address_parts(F.col(url_col))
    declared = F.lower(F.regexp_extract(html_col, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.when(F.length(declared) > 0, declared).alias("declared"), suffix.alias("suffix"), F.when(host.isNotNull(), domain).alias("domain"), host.alias("host"), F.col(html_col).alias("html"))
    keep = ("page_id", "url", "declared", "suffix", "domain", "host")
    texts = main_text.main_text(read, "html", keep).select(*keep, "text")
    out = texts.select(*keep, F.array().cast("array<double>").alias("likelihoods")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for batch in W.slices(whole, "text"):
                grams, first = trigram_buckets([t or "" for t in batch.column(len(keep)).to_pylist()])
                found = np.empty((batch.num_rows, len(table)))
                for i, logs in enumerate(table):
                    sums = np.concatenate([[0.0], np.cumsum(logs[grams], dtype=np.float64)])
                    found[:, i] = (sums[first[1:]] - sums[first[:-1]]) / DEPENDENCE
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(list(found), pa.list_(pa.float64()))], names=[*keep, "likelihoods"])

    return texts.mapInArrow(run, out)


def _normalised(logs: Column) -> Column:
    """Log scores of all languages as probabilities."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(shares: DataFrame, by: str) -> DataFrame:
    """For each value of ``by``: the shares of each language, summed, as an array."""
    found = shares.filter(F.col(by).isNotNull()).groupBy(by, "at").agg(F.sum("share").alias("share"))
    return found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("at", "share"))).alias(f"{by}_sums"))


def _share(sums: Column, at: Column) -> Column:
    return F.coalesce(F.try_element_at(sums, at), F.lit(0.0))


def fused(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """``page_id, url, lang, probability, text_lang, declared, suffix, host`` from settled text evidence."""
    count = len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    pages = evidence.withColumn("posterior", _normalised(F.col("likelihoods")))
    shares = pages.select("declared", "suffix", "domain", "host", F.posexplode("posterior").alias("at", "share")).filter(F.col("share") >= LEAST_SHARE)
    totals = shares.groupBy("at").agg(F.sum("share").alias("share")).collect()  # a row per language
    total = {r["at"]: r["share"] for r in totals}
    every = sum(total.values())
    base = [(total.get(i, 0.0) + 1.0) / (every + count) for i in range(count)]
    joined = pages
    for by in ("declared", "suffix", "domain", "host"):
        joined = joined.join(settle(_sums(shares, by), f"language-{by}"), by, "left")
    kinds = {by: settle(shares.filter(F.col(by).isNotNull()).agg(F.countDistinct(by).alias("n")), "kinds").first()["n"] for by in ("declared", "suffix")}

    def own(at: Column) -> Column:
        share = F.get("posterior", at)
        return F.when(share >= LEAST_SHARE, share).otherwise(0.0)

    def seen(by: str, at: Column, overall: Column) -> Column:
        """log P(value | language), without the page itself; 0 where the page has no value."""
        return F.when(F.col(by).isNull(), 0.0).otherwise(F.log((F.greatest(_share(F.col(f"{by}_sums"), at) - own(at), F.lit(0.0)) + UNSEEN) / (overall + UNSEEN * (kinds[by] + 1))))

    def whole(by: str) -> Column:
        return F.coalesce(F.aggregate(F.map_values(f"{by}_sums"), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))

    def level(by: str, at: Column, wider: Column) -> Column:
        less_own = F.greatest(_share(F.col(f"{by}_sums"), at) - own(at), F.lit(0.0))
        others = F.greatest(whole(by) - F.aggregate("posterior", F.lit(0.0), lambda a, b: a + F.when(b >= LEAST_SHARE, b).otherwise(0.0)), F.lit(0.0))
        return F.when(F.col(by).isNull(), wider).otherwise((less_own + F.lit(SMOOTHING) * wider) / (others + SMOOTHING))

    scores = []
    for i in range(count):
        at = F.lit(i)
        overall = F.lit(float(total.get(i, 0.0)))
        prior = level("host", at, level("domain", at, F.lit(base[i])))
        scores.append(F.get("likelihoods", at) + seen("declared", at, overall) + seen("suffix", at, overall) + F.log(prior))
    final = joined.withColumn("final", _normalised(F.array(*scores)))
    best = (F.array_position("final", F.array_max("final")) - 1).cast("int")
    heard = (F.array_position("likelihoods", F.array_max("likelihoods")) - 1).cast("int")
    blank = F.array_max("likelihoods") == F.array_min("likelihoods")
    return final.select(
        "page_id", "url", F.get(names, best).alias("lang"), F.array_max("final").alias("probability"),
        F.when(~blank | F.lit(count == 1), F.get(names, heard)).alias("text_lang"), "declared", "suffix", "host",
    )


def page_languages(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The language of every page."""
    langs, model = text_model(docs)
    if not langs:
        host, _, suffix = address_parts(F.col(url_col))
        nothing = F.lit(None).cast("string")
        return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), nothing.alias("lang"), F.lit(0.0).alias("probability"), nothing.alias("text_lang"), nothing.alias("declared"), suffix.alias("suffix"), host.alias("host"))
    return fused(settle(text_evidence(pages, langs, model, id_col, url_col, html_col), "language-text"), langs)
