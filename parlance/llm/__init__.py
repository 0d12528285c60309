"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from parlance.llm import queries as _queries  # noqa: F401 - importing it fills the registry
from parlance.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
