"""Explicit schemas of the store's tables, enumerations and row validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 8

KNOWLEDGE_TYPES = ("structured", "narrative", "factual", "quote", "mixed")
IMPORT_STRATEGIES = ("auto", "narrative", "factual", "quote")
VECTOR_STATES = ("none", "pending", "ready", "failed")
QUEUE_STATES = ("pending", "running", "done", "failed")

_RELATION = (
    "hash string, subject string, predicate string, object string, confidence double, vector_state string, vector_updated_at double, vector_error string,"
    " vector_retry_count int, created_at double, source_paragraph string, is_permanent boolean, last_accessed double, access_count bigint,"
    " is_inactive boolean, inactive_since double, is_pinned boolean, protected_until double, last_reinforced double"
)
#: DDL of each table of a snapshot.
TABLES: dict[str, str] = {
    "paragraph": "hash string, content string, source string, word_count int, knowledge_type string, created_at double, updated_at double, event_time double,"
    " event_time_start double, event_time_end double, time_granularity string, time_confidence double, is_permanent boolean, last_accessed double,"
    " access_count bigint, is_deleted boolean, deleted_at double, metadata map<string,string>",
    "entity": "hash string, name string, appearance_count bigint, created_at double, is_deleted boolean, deleted_at double",
    "relation": _RELATION,
    "deleted_relation": _RELATION + ", deleted_at double",
    "paragraph_entity": "paragraph_hash string, entity_hash string, mention_count int",
    "paragraph_relation": "paragraph_hash string, relation_hash string",
    "vector": "hash string, item_type string, embedding array<float>",
    "posting": "term string, doc_hash string, tf int, dl int",
    "node": "canon string, name string",
    "edge": "src string, dst string, weight double, relation_hashes array<string>",
    "edge_state": "src string, dst string, weight double, since double",
    "edge_set": "src string, dst string, relation_hashes array<string>",
    "edge_due": "hour bigint, src string, dst string",
    "episode": "episode_id string, source string, title string, summary string, event_time_start double, event_time_end double, time_granularity string,"
    " time_confidence double, participants array<string>, keywords array<string>, evidence_ids array<string>, paragraph_count int, llm_confidence double,"
    " segmentation_model string, segmentation_version string, created_at double, updated_at double",
    "episode_paragraph": "episode_id string, paragraph_hash string, position int",
    "rebuild_source": "source string, status string, retry_count int, last_error string, reason string, requested_at double, updated_at double",
    "profile_switch": "stream_id string, user_id string, enabled boolean, updated_at double",
    "active_person": "stream_id string, user_id string, person_id string, last_seen_at double",
    "profile_snapshot": "person_id string, profile_version int, profile_text string, aliases array<string>, relation_edges array<string>,"
    " vector_evidence array<string>, evidence_ids array<string>, updated_at double, expires_at double, source_note string",
    "profile_override": "person_id string, override_text string, updated_at double, updated_by string, source string",
}

#: (columns by which rows are dealt to buckets, columns that name a row) of each table.
KEYS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "paragraph": (("hash",), ("hash",)),
    "entity": (("hash",), ("hash",)),
    "relation": (("hash",), ("hash",)),
    "deleted_relation": (("hash",), ("hash",)),
    "vector": (("hash",), ("hash", "item_type")),
    "paragraph_entity": (("paragraph_hash",), ("paragraph_hash", "entity_hash")),
    "paragraph_relation": (("paragraph_hash",), ("paragraph_hash", "relation_hash")),
    "node": (("canon",), ("canon",)),
    "edge": (("src",), ("src", "dst")),
    "edge_state": (("src",), ("src", "dst")),
    "edge_set": (("src",), ("src", "dst")),
    "edge_due": (("hour",), ("hour", "src", "dst")),
    "episode": (("source",), ("episode_id",)),
    "episode_paragraph": (("episode_id",), ("episode_id", "paragraph_hash")),
    "rebuild_source": (("source",), ("source",)),
    "active_person": (("person_id",), ("stream_id", "user_id", "person_id")),
    "profile_switch": (("stream_id",), ("stream_id", "user_id")),
    "profile_snapshot": (("person_id",), ("person_id", "profile_version")),
    "profile_override": (("person_id",), ("person_id",)),
}


def validate(df: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) by an enumeration; null is invalid."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.where(ok), df.where(~ok)
