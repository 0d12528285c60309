"""Explicit schemas: the given tables and the archive's own tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

GIVEN = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey LONG, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP",
    "events": "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
    "embeddings": "vec_id LONG, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id LONG, url STRING, html STRING",
    "benchmark": "item_id LONG, text STRING",
    "labels": "doc_id LONG, quality INT, toxic INT",
    "conversations": "conv_id LONG, turn LONG, role STRING, text STRING",
}

SEGMENT = "STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, speaker: STRING, speaker_id: STRING>"

ARCHIVE = {
    "audio_sessions": "id STRING, user_id STRING, client_id STRING, device_name STRING, parent_id STRING,"
    " started_at TIMESTAMP, ended_at TIMESTAMP, duration_s DOUBLE, codec STRING, sample_rate_hz INT,"
    " audio_path STRING, bytes_written LONG, status STRING, error_msg STRING, archived BOOLEAN",
    "transcripts": f"id STRING, audio_session_id STRING, text STRING, segments ARRAY<{SEGMENT}>,"
    " language STRING, model STRING, created_at TIMESTAMP",
    "conversations": "id STRING, audio_session_id STRING, user_id STRING, title STRING, summary STRING,"
    " topics ARRAY<STRING>, extraction_repaired BOOLEAN, quality_score DOUBLE, quality_reasoning STRING,"
    " quality_override DOUBLE, started_at TIMESTAMP, ended_at TIMESTAMP, created_at TIMESTAMP,"
    " updated_at TIMESTAMP",
    "calendar_events": "id STRING, conversation_id STRING, title STRING, description STRING,"
    " starts_at TIMESTAMP, ends_at TIMESTAMP, location STRING, attendees ARRAY<STRING>, confidence DOUBLE,"
    " exported_to_ics BOOLEAN, created_at TIMESTAMP",
    "action_items": "id STRING, conversation_id STRING, text STRING, due_at TIMESTAMP, owner STRING,"
    " status STRING, created_at TIMESTAMP",
    "decisions": "id STRING, conversation_id STRING, text STRING, made_by STRING, confidence DOUBLE,"
    " created_at TIMESTAMP",
    "people_mentions": "id STRING, conversation_id STRING, name STRING, context STRING,"
    " mentioned_at TIMESTAMP",
    "speakers": "id STRING, user_id STRING, name STRING, embedding ARRAY<FLOAT>, is_user BOOLEAN,"
    " mention_count INT, preview_audio_session_id STRING, preview_start_s DOUBLE, preview_end_s DOUBLE,"
    " created_at TIMESTAMP, updated_at TIMESTAMP",
    "wake_actions": "id STRING, user_id STRING, name STRING, phrases ARRAY<STRING>,"
    " stop_phrases ARRAY<STRING>, command STRING, enabled BOOLEAN, timeout_seconds INT,"
    " created_at TIMESTAMP, updated_at TIMESTAMP",
    "daily_summaries": "id STRING, user_id STRING, date STRING, narrative STRING,"
    " conversation_ids ARRAY<STRING>, conversation_count INT, quality_threshold DOUBLE,"
    " created_at TIMESTAMP",
    "wake_invocations": "id STRING, wake_action_id STRING, conversation_id STRING, matched_phrase STRING,"
    " input_text STRING, command_resolved STRING, exit_code INT, stdout STRING, stderr STRING,"
    " duration_ms INT, created_at TIMESTAMP",
}

# Defaults that additive schema changes give to rows written before the column existed.
DEFAULTS = {
    "audio_sessions": {"archived": False, "bytes_written": 0},
    "conversations": {"quality_score": 0.5, "extraction_repaired": False},
    "calendar_events": {"confidence": 0.5, "exported_to_ics": False},
    "decisions": {"confidence": 0.5},
    "speakers": {"is_user": False, "mention_count": 1},
}

STATUSES = (
    "recording",
    "pending_vad",
    "segmented",
    "pending_stt",
    "pending_llm",
    "done",
    "silent",
    "failed",
)


def schema(name: str) -> StructType:
    return StructType.fromDDL(ARCHIVE[name])


def given_schema(name: str) -> StructType:
    return StructType.fromDDL(GIVEN[name])
