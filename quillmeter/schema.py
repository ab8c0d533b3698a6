"""Schemas of the normalized relations."""

from __future__ import annotations

TOKENS = "STRUCT<input: BIGINT, output: BIGINT, cache_read: BIGINT, cache_write: BIGINT, cache_write_1h: BIGINT, reasoning: BIGINT>"
USAGE_EVENT = (
    "harness STRING, timestamp STRING, ts_ms BIGINT, session_id STRING, message_id STRING, turn BOOLEAN, subagent BOOLEAN, "
    f"model STRING, tokens {TOKENS}, calls BIGINT, cost_usd DOUBLE, workspace STRING, title STRING"
)
SEQ = "seq STRUCT<reader: INT, lane: INT, root_ord: INT, src_path: STRING, src_ord: BIGINT>"
TIER = "STRUCT<threshold: DOUBLE, input: DOUBLE, output: DOUBLE, cache_read: DOUBLE, cache_write: DOUBLE, cache_write_1h: DOUBLE>"
PRICE = f"STRUCT<input: DOUBLE, output: DOUBLE, cache_read: DOUBLE, cache_write: DOUBLE, cache_write_1h: DOUBLE, tiers: ARRAY<{TIER}>, tier_mode: STRING>"
CATALOG = f"catalog_ord INT, source STRING, fetched_at STRING, is_override BOOLEAN, key_ord INT, key STRING, price {PRICE}"
DIAGNOSTIC = "severity STRING, message STRING, harness STRING, path STRING"
SKIPPED = "harness STRING, location STRING"
COUNTERS = ("input", "output", "cache_read", "cache_write", "reasoning")
