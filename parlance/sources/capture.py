"""Landing files and silence logs as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.values import codec_of
from parlance.operators.scans import island_ids

MAX_BYTES = 500 * 1024 * 1024  # fixed value: largest accepted upload, unless the caller says otherwise
LINE_CHUNK = 4096


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: ``path, length, modificationTime``; their bytes are not read.

    Spark's scan leaves out files without any byte, so empty uploads do not appear at all.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def empty_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files without any byte right below a folder or its folders, which ``landed`` does not list: ``path, length, modificationTime``.

    The driver lists the folders, tasks the files in them; hidden names are left out as Spark does.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    inside = [str(f.getPath()) for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place) if f.isDirectory()]
    shown = [f for f in inside if not f.rsplit("/", 1)[1].startswith((".", "_"))]
    kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for where, deep in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = fs.FileSystem.from_uri(where) if ":" in where else (fs.LocalFileSystem(), where)
                found = system.get_file_info(fs.FileSelector(path, recursive=deep))
                empty = [f for f in found if f.is_file and f.size == 0 and not f.base_name.startswith((".", "_"))]
                yield pa.RecordBatch.from_pydict({"path": [f.path for f in empty], "length": [0] * len(empty), "modificationTime": [f.mtime for f in empty]}, schema=kinds)

    places = spark.createDataFrame([(folder, False)] + [(f, True) for f in shown], "place string, deep boolean")
    return places.repartition(spark.sparkContext.defaultParallelism).mapInArrow(listed, "path string, length long, modificationTime timestamp")


def accepted(files: DataFrame, skip_vad: bool = False, vad_enabled: bool = True, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Session rows of acceptable files, and the rejected files with a reason."""
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too large")
    status = "pending_stt" if skip_vad or not vad_enabled else "pending_vad"
    judged = files.withColumn("reason", reason)
    sessions = judged.filter(F.col("reason").isNull()).select(
        F.sha2("path", 256).substr(1, 32).alias("id"),
        F.col("path").alias("audio_path"),
        codec_of(F.col("path")).alias("codec"),
        F.col("length").alias("bytes_written"),
        F.col("modificationTime").alias("started_at"),
        F.col("modificationTime").alias("ended_at"),
        F.lit(status).alias("status"),
    )
    return sessions, judged.filter(F.col("reason").isNotNull()).select("path", "length", "reason")


def silence_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines in file order: ``path, line_no, line``.

    A log is one small file of a capture, so it is read whole and split on its row.
    """
    files = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))


def _number(line: Column, mark: str) -> Column:
    return F.regexp_extract(line, mark + r":\s*([\-\d.]+)", 1)


def paired_silences(lines: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``start, end`` pairs: an end belongs to the start right before it among the marks.

    A start that no end follows, and an end without a fresh start, yield nothing.
    """
    start, end = _number(F.col("line"), "silence_start"), _number(F.col("line"), "silence_end")
    marks = lines.select(
        *keys,
        "line_no",
        F.when(start != "", "s").when(end != "", "e").alias("kind"),
        F.when(start != "", start).otherwise(end).try_cast("double").alias("at"),
    ).filter(F.col("kind").isNotNull())
    # Every start opens a group; the first end in it closes the pair.
    groups = island_ids(
        marks,
        list(keys),
        F.floor(F.col("line_no") / LINE_CHUNK),
        ["line_no"],
        ["kind"],
        lambda prev, cur: cur["kind"] == "s",
        name="pair",
    )
    pairs = groups.groupBy(*keys, "pair").agg(
        F.min_by("at", F.when(F.col("kind") == "s", F.col("line_no"))).alias("start"),
        F.min_by("at", F.when(F.col("kind") == "e", F.col("line_no"))).alias("end"),
    )
    return pairs.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).select(*keys, "start", "end")


def logged_durations(lines: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Seconds of the first ``Duration: h:m:s`` line."""
    part = lambda i: F.regexp_extract("line", r"Duration:\s*(\d+):(\d+):([\d.]+)", i)
    hits = lines.filter(part(1) != "").withColumn(
        "duration_s", part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double")
    )
    return hits.groupBy(*keys).agg(F.min_by("duration_s", "line_no").alias("duration_s"))
