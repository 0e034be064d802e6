"""Table schemas. A missing string is '' and never null; in_app is the one real null."""

from __future__ import annotations

SCHEMA_VERSION = 1

EVENT = (
    "event_id string, project_id bigint, ts_ns bigint, level string, fingerprint string, release string,"
    " environment string, user_id string, message string, payload binary, schema_version int"
)
FRAME = "struct<function: string, module: string, filename: string, abs_path: string, in_app: boolean>"
EXCEPTIONS = f"array<struct<type: string, value: string, frames: array<{FRAME}>>>"
RECORD = (
    "arrival_seq bigint, received_at timestamp, kind tinyint, project_id bigint, public_key string,"
    " content_encoding string, body binary"
)
ITEM = (
    "arrival_seq bigint, received_at timestamp, project_id bigint, item_no int, item_type string,"
    " header_event_id string, payload binary, reason string"
)
HIT = "arrival_seq bigint, project_id bigint, fingerprint string, basis string, title string, level string, seen_at bigint"
COMMAND = "arrival_seq bigint, project_id bigint, kind string, fingerprint string, target string, sources array<string>, status string"

#: Why a record or item was not stored.
REASONS = ("malformed", "duplicate", "overloaded", "too_large", "auth")
