"""Column expressions over embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 for a zero vector or for different lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def running_mean(stored: Column, new: Column, n: Column) -> Column:
    """The centroid after one more observation: ``(stored * n + new) / (n + 1)``."""
    return F.zip_with(_doubles(stored), _doubles(new), lambda s, x: (s * n + x) / (n + 1))


def is_zero(vector: Column) -> Column:
    return ~F.exists(vector, lambda x: x != 0)
