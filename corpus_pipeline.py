"""A corpus pipeline of five stages over ``documents``: toxicity, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all but the last keep the
columns of its input. A stage's result has to be written before the next stage is called: that one drops the tables that the one
before has settled. ``run`` writes each stage as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from parlance.llm.names import free_names
from parlance.session import drop_tables, settle, settled_in

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents that score this or more are rejected.
TOXIC = 0.5

_settled: list[str] = []


def stage(work: Stage) -> Stage:
    """A stage that first drops what the stage before it has settled: that one's result is written by now."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _settled)
        _settled.clear()
        with settled_in(_settled):
            return work(spark, docs, sf_dir)

    return run_stage


def without(docs: DataFrame, rejected: DataFrame, label: str) -> DataFrame:
    """The rows of ``docs`` but those with an id and text (``text_hash``; a null text has one too) of ``rejected``."""
    doc, text_hash = free_names(docs, f"{label}_id", f"{label}_hash")
    gone = settle(rejected.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)).distinct(), label)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), "left_anti")


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below ``TOXIC``; the labels teach the rules and decide nothing else."""
    scored = toxicity.scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scored.filter(F.col("score") >= TOXIC), "toxic")


@stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id, ids that are
    null last, of several texts of that id the one with the least hash.

    Rows that are equal in id and text are one document; of these the row with the least hash of all its columns stays.
    """
    judged = settle(near_dedup.components_of(docs, width=5, percent=80).filter("component is not null").select("component", "doc_id", "text_hash").distinct(), "judged")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    chosen = judged.groupBy("component").agg(F.min(order).alias("stays"))
    kept = without(docs, judged.join(chosen, "component").filter(~order.eqNullSafe(F.col("stays"))), "dropped")
    again_id, again_hash, rows, row = free_names(docs, "again_id", "again_hash", "rows", "row")
    repeated = docs.groupBy(F.col("doc_id").alias(again_id), F.xxhash64("text").alias(again_hash)).agg(F.count(F.lit(1)).alias(rows)).filter(F.col(rows) > 1).drop(rows)
    repeated = settle(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col(again_id)) & (F.xxhash64("text") == F.col(again_hash))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.join(repeated, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row))
    return kept.join(repeated, same, "left_anti").unionByName(once.select(f"{row}.*"))


@stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight (size to the power of a half), shuffled."""
    names = free_names(docs, "mix_copy", "mix_order")
    return mixing.mixed(docs, None, 0.5, 1.0, 17, *names).drop(*names)


@stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files with their index; per stored document what is read back: copies of a document follow each other."""
    import public_tokenizers

    out = token_files.stored_tokens(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.col("copy").alias("copy_no"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: SQL can express neither the decoding nor the components; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = settle(work(spark, docs, sf_dir), f"stage-{name}")
    return docs
