"""Operators for large-scale training-data pipelines (sharding, dedup, tokenising, mixing, search)."""
