"""A query of every catalog module against its SQL twin; ``tests/oracle.py`` runs all of them."""

import pytest

duckdb = pytest.importorskip("duckdb")

import oracle  # noqa: E402
from parlance.catalog import ORACLE, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "activity_conversations", "speaker_turns", "linked_clusters", "linked_to_registry_in_order", "speakers_after_deleting", "label_mapping",
    "diarization_errors", "written_case_turns", "index_page", "rated_conversations", "digest_lines", "trigger_invocations",
    "extracted_conversations", "calendar_blocks", "live_conversations", "tolerant_values",
)


@pytest.fixture(scope="module")
def views():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, views, name):
    verdict, count, _, note = oracle.compare(spark, views, FOLDER, name, QUERIES[name], ORACLE[name])
    assert verdict == "ok", note
