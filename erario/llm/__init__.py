"""Operators for preparing training data: search, counting, scanning, mixing, packing, filtering, deduplication."""
