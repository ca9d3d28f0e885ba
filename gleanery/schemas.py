"""Declared schemas of the curation tables."""

from __future__ import annotations

TABLES = {
    "sources": (
        "source_id string, source_type string, source_ref string, source_url string, name string, "
        "topic string, status string, created_at timestamp, updated_at timestamp"
    ),
    "sync_state": (
        "source_id string, cursor string, last_synced_at timestamp, last_success_at timestamp, "
        "last_error_at timestamp, last_error_message string"
    ),
    "capture_entries": (
        "capture_entry_id string, entry_type string, source_id string, trigger_ref string, "
        "entry_status string, metadata string, captured_at timestamp"
    ),
    "raw_assets": (
        "raw_asset_id string, capture_entry_id string, asset_type string, external_id string, title string, "
        "author string, url string, published_at timestamp, raw_content string, raw_metadata string, "
        "status string, created_at timestamp"
    ),
    "items": (
        "item_id string, raw_asset_id string, item_type string, title string, canonical_url string, "
        "canonical_url_conflict string, author string, published_at timestamp, language string, "
        "content_text string, status string, duplicate_of_item_id string, created_at timestamp"
    ),
    "enrichments": (
        "item_id string, version_id string, importance_score double, novelty_score double, "
        "summary_short string, summary_long string, key_points array<string>, tags array<string>, "
        "topic string, classification string, why_it_matters string, preserve_recommendation string, "
        "note_draft string, dedupe_key string, is_current boolean, created_at timestamp, "
        "superseded_at timestamp"
    ),
    "item_groups": (
        "group_id string, group_type string, tag string, title string, summary string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "item_group_members": "group_id string, item_id string",
    "inbox_selections": (
        "run_id bigint, item_id string, selected boolean, relevance_score double, "
        "score_breakdown struct<importance_score:double,novelty_score:double,quality_adjustment:double,"
        "total_score:double>, selection_reasons array<string>, policy_version string"
    ),
    "notes": (
        "note_id string, item_id string, note_type string, title string, body_md string, "
        "highlights array<string>, tags array<string>, review_weight double, created_at timestamp"
    ),
    "destinations": (
        "destination_id string, destination_type string, name string, target_ref string, status string"
    ),
}

ENUM_COLUMNS = {
    "sources": {"source_type": "source_type", "status": "source_status"},
    "capture_entries": {"entry_type": "entry_type", "entry_status": "entry_status"},
    "raw_assets": {"asset_type": "asset_type", "status": "asset_status"},
    "items": {"item_type": "item_type", "status": "item_status"},
    "enrichments": {"preserve_recommendation": "preserve_recommendation"},
    "item_groups": {"group_type": "group_type"},
    "notes": {"note_type": "note_type"},
    "destinations": {"destination_type": "destination_type", "status": "destination_status"},
}
