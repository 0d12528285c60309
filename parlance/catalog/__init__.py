"""Registered queries; importing this package fills the registry."""

import importlib

from parlance.catalog.registry import ORACLE, QUERIES

for _name in ("segmentation", "transcripts", "speakers", "evals", "archive", "daily", "changes", "triggers", "extraction", "exports", "streams"):
    importlib.import_module(f"parlance.catalog.{_name}")

__all__ = ["ORACLE", "QUERIES"]
