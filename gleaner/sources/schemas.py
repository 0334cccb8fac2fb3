"""Declared schemas; nothing is inferred."""

from __future__ import annotations

MESSAGE = "role string, content string, timestamp bigint"
REQUEST = "request_id string, user_id string, session_id string, messages array<struct<role:string,content:string,timestamp:bigint>>"
QUERY = "query_id string, user_id string, query string, options array<string>, top_k int"
MEMORY = (
    "memory_id string, row_id bigint, user_id string, session_id string, request_id string, ordinal int, role string, content string, "
    "occurred_at bigint, created_at string, search_text string"
)
LEDGER = "user_id string, request_id string, session_id string, payload_hash string, created_at string"
EMBEDDING = "memory_id string, user_id string, model string, dimensions int, vector array<double>"
POSTING = "user_id string, memory_id string, term string, tf double"
DOCUMENT = "memory_id string, user_id string, dl double"
TERMS = "memory_id string, held array<string>, whole array<string>, brief array<string>, claims array<array<string>>, updates boolean"
PANEL = (
    "user_id string, history_id string, session_id string, memory string, messages array<string>, question string, query string, "
    "evidence array<string>, evidence_ids array<string>"
)
TABLES = {"memories": MEMORY, "requests": LEDGER, "embeddings": EMBEDDING, "postings": POSTING, "docs": DOCUMENT, "terms": TERMS}
