"""Operators for large text corpora: mixing, deduplication, sharding, extraction, packing, scoring."""
