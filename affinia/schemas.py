"""Tables of the media store, with their keys. Schemas are declared, never inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

SCHEMA_VERSION = 31
READER_SHAPE = 1


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


TABLES: dict[str, Table] = {
    "items": Table("item_id STRING, type STRING, title STRING, sort_title STRING, year INT, show_item_id STRING, season INT, episode INT, duration_ms BIGINT, library STRING", ("item_id",)),
    "external_ids": Table("namespace STRING, value STRING, kind STRING, item_id STRING, last_seen TIMESTAMP", ("namespace", "value", "kind")),
    "plex_items": Table("rating_key STRING, item_id STRING", ("rating_key",)),
    "enrichment": Table("item_id STRING, namespace STRING, source STRING, key STRING, value STRING, fetched_at TIMESTAMP, rank INT", ("item_id", "namespace", "source", "key", "value")),
    "enrichment_cursor": Table("item_id STRING, namespace STRING, source STRING, attempted_at TIMESTAMP, fetched_at TIMESTAMP", ("item_id", "namespace", "source")),
    "edges": Table("from_id STRING, to_id STRING, edge_type STRING, rank INT", ("from_id", "to_id", "edge_type")),
    "plays": Table("history_key STRING, item_id STRING, account_id BIGINT, device_id STRING, viewed_at BIGINT, ip STRING, seconds_watched BIGINT, source_id BIGINT, rating_key STRING", ("history_key",)),
    "collection": Table("collection_id STRING, name STRING, source STRING, url STRING, size INT, likes INT, provenance STRING, seed_count INT", ("collection_id",)),
    "collection_entry": Table("collection_id STRING, namespace STRING, value STRING, kind STRING, rank INT", ("collection_id", "namespace", "value", "kind")),
    "collection_membership": Table("collection_id STRING, item_id STRING, rank INT, mentions INT", ("collection_id", "item_id")),
    "keyword_forms": Table("surface STRING, keyword STRING", ("surface",)),
    "keyword_surfaces": Table("item_id STRING, source STRING, surface STRING, rank INT, spoiler BOOLEAN, fetched_at TIMESTAMP", ("item_id", "source", "surface")),
    "keyword_names": Table("keyword STRING, name STRING, decided_at TIMESTAMP", ("keyword",)),
    "keyword_pairs": Table("a STRING, b STRING, score DOUBLE, decision STRING, decided_at TIMESTAMP", ("a", "b")),
    "keyword_roles": Table("keyword STRING, role STRING, score DOUBLE", ("keyword", "role")),
    "media_part": Table("part_id BIGINT, item_id STRING, file STRING, size BIGINT, height INT, duration_ms BIGINT, file_hash STRING, present BOOLEAN", ("part_id",)),
    "audio_facts": Table("file_hash STRING, facts STRING", ("file_hash",)),
    "frames": Table("item_id STRING, t_ms BIGINT, shot INT, vector ARRAY<TINYINT>, model STRING", ("item_id", "t_ms")),
    "cuts": Table("item_id STRING, t_ms BIGINT", ("item_id", "t_ms")),
}
