"""Table scans, tolerant column decoding and additive schema evolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructType

from parlance import schemas


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, with its fixed schema (timestamps as instants, UTC)."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(schemas.given_schema(name)).parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An archive table; files written before a column was added get its default."""
    return evolve(spark.read.schema(schemas.schema(name)).parquet(f"{folder}/{name}"), name)


def evolve(df: DataFrame, name: str, target: StructType | None = None) -> DataFrame:
    """Bring ``df`` to the target columns: add what is missing, fill the defaults."""
    target = target or schemas.schema(name)
    defaults = schemas.DEFAULTS.get(name, {})
    columns = []
    for field in target.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def decode_segments(raw: Column) -> Column:
    """Segments text column to an array; anything unreadable becomes an empty array."""
    parsed = F.from_json(raw, f"ARRAY<{schemas.SEGMENT}>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(parsed, lambda s: s.isNotNull()), F.array())


def encode_segments(segments: Column) -> Column:
    return F.to_json(segments)


def explode_segments(transcripts: DataFrame, session: str = "audio_session_id") -> DataFrame:
    """Long form, one row per segment: ``session_id, pos, start, end, text, speaker, speaker_id``."""
    return transcripts.select(
        F.col(session).alias("session_id"), F.posexplode("segments").alias("pos", "s")
    ).select("session_id", "pos", "s.*")


@F.pandas_udf(ArrayType(FloatType()))
def decode_embedding(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array; used only where raw bytes arrive."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(BinaryType())
def encode_embedding(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
