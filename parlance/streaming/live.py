"""Streams over archive data: sources, sinks, live sessions, live triggers, stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import schemas
from parlance.operators.rows import updated
from parlance.plans.triggers import invocations
from parlance.session import shared_path

# The state that each stage picks up, and where its output goes.
STAGES = {"vad": "pending_vad", "stt": "pending_stt", "llm": "pending_llm"}
NEXT = {"vad": "segmented", "stt": "pending_llm", "llm": "done"}


def given_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A given table as a file stream, a bounded number of files per trigger."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return (
        spark.readStream.schema(schemas.given_schema(name))
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/{name}.parque[t]")  # a pattern, as file streams want one, that only this table meets
    )


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all data that is there, into a table of the shared folder."""
    spark = stream.sparkSession
    table, log = shared_path(spark, label), shared_path(spark, f"{label}-log")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", log)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def live_conversations(activity: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Conversations of a live stream: a pause of the gap ends one (event time).

    They come out once the watermark has passed their end; later rows are dropped.
    """
    return (
        activity.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n_events"))
        .drop("session_window")
    )


def live_invocations(transcripts: DataFrame, actions: DataFrame) -> DataFrame:
    """Trigger invocations of arriving transcripts; a stateless join with the action table."""
    return invocations(transcripts, actions)


def stage_step(
    stage: str, sessions: DataFrame, work: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """One pass of a stage over everything that waits for it.

    ``work`` gets the waiting sessions and returns ``id, error_msg`` for those it handled.
    Returns the new sessions and the dead letters; one failure never stops the others.
    """
    done = work(sessions.filter(F.col("status") == STAGES[stage])).select(
        "id",
        F.when(F.col("error_msg").isNull(), NEXT[stage]).otherwise("failed").alias("status"),
        F.substring("error_msg", 1, 500).alias("error_msg"),
    )
    return updated(sessions, done, "id", ["status", "error_msg"]), done.filter(F.col("error_msg").isNotNull())


def first_usable(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the primary backend, and of the fallback for keys that it did not serve."""
    missing = fallback.join(primary.select(*keys).distinct(), keys, "left_anti")
    return primary.unionByName(missing)


def run_stage(stream: DataFrame, stage: str, work: Callable[[DataFrame], DataFrame], target: str, log: str, dead: str | None = None):
    """Run a stage on every micro-batch of arriving sessions; outcomes are appended to ``target``.

    Dead letters (``id, status, error_msg``) are appended to ``dead``, ``<target>-dead`` where it is not given. A repeated
    batch replaces what it wrote before.
    """
    letters = dead or f"{target}-dead"

    def handle(batch: DataFrame, batch_id: int) -> None:
        advanced, failed = stage_step(stage, batch, work)
        failed.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{letters}/batch={batch_id}")
        advanced.filter(F.col("status") != STAGES[stage]).withColumn("batch", F.lit(batch_id)).write.mode(
            "overwrite"
        ).parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", log).trigger(availableNow=True).start()
