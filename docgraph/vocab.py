"""Closed vocabularies and constants of the data model (fixed values)."""

from __future__ import annotations

ITEM_TYPES = ("fact", "decision", "event", "emotion", "signal", "open_loop")
ENTITY_TYPES = ("person", "place", "org", "concept", "other")
ROLES = ("subject", "object", "mentioned")
TOPICS = ("admin", "education", "family", "finance", "health", "housing", "legal", "logistics", "other", "relationships", "spirituality", "travel", "work")
PATTERN_KINDS = ("principle", "fear", "behavior", "goal", "constraint")
ACTION_KINDS = ("protocol", "experiment", "claim", "reach", "build", "decline", "commit")
RECORD_KINDS = ("document", "chunk", "fact", "entity", "pattern", "insight", "action")
EDGE_KINDS = ("mention", "derivation", "sibling", "relation", "containment")
RETRIEVAL_RANK = {"action": 0, "insight": 1, "pattern": 2, "entity": 3, "fact": 4, "document": 5, "chunk": 6}

CHARS_PER_TOKEN = 3
CHUNK_TOKENS, OVERLAP_TOKENS = 512, 64
CHUNK_CHARS, STRIDE_CHARS = CHUNK_TOKENS * CHARS_PER_TOKEN, (CHUNK_TOKENS - OVERLAP_TOKENS) * CHARS_PER_TOKEN
SPLIT_BUDGET, BATCH_ENTRY_TOKENS, LEAD_TOKENS = 16_000, 8_000, 2_000
CHAT_GAP_SECONDS = 21_600
MAX_FILE_BYTES = 41_943_040
MERGE_FLOOR, MERGE_TRUST = 0.85, 0.9
PATTERN_CAP, INSIGHT_CAP, ACTION_CAP = 75, 10, 10
JUNK_DISTANCE = 0.5
LOOKUP_COUNT, LOOKUP_MAX, LOOKUPS_MAX, UNION_MAX = 15, 20, 3, 50
EMBEDDING_BATCH = 32
SIZE_EDGES = (0, 200, 500, 1000, 2000)
ACTION_WEIGHTS = (0.25, 0.20, 0.15, 0.15, 0.10, 0.075, 0.075)
HORIZON_DAYS = {"short": 14, "medium": 90, "long": 90}
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".bmp", ".tiff", ".webp", ".gif")
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".json", ".jsonl")
BINARY_SUFFIXES = (".pdf", ".docx", ".doc", ".zip")
EXCLUDED_SUFFIXES = (".html", ".htm")
