"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lists of settled paths, of the open ``steps`` blocks.
_OWNERS: list[list[str]] = []

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "parlance", cpus: int | str = "*", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **SQL_SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.driver.extraJavaOptions": "-Djava.net.preferIPv4Stack=true",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a scratch folder is made and set, once per session. On a
    cluster each executor would write to its own disk, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="parlance-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that steps inside the block have settled, once the block ends.

    Write the job's result inside the block, outside the shared folder's tables: what is read later must not need them.
    """
    owned: list[str] = []
    try:
        with settled_in(owned):
            yield
    finally:
        drop_tables(spark, owned)


@contextmanager
def settled_in(owned: list[str]) -> Iterator[None]:
    """Note the tables that steps inside the block settle in ``owned``."""
    _OWNERS.append(owned)
    try:
        yield
    finally:
        _OWNERS[:] = [o for o in _OWNERS if o is not owned]


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from that table.

    Used where a result feeds several branches: the work before it runs once, a lost
    executor restarts from the table, and the readers prune columns and know its size.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    if _OWNERS:
        _OWNERS[-1].append(path)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(df: DataFrame) -> int:
    """Tasks to give to work whose cost does not follow its bytes.

    An explicit count also keeps adaptive execution from merging such small partitions.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all tasks where the input has fewer splits than the cluster has cores.

    A large input has more splits than that and is left as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
