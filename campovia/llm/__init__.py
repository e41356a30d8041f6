"""Operators of a training-data pipeline: deduplication, tokenising, search, fixity, quality, formatting, sharding, packing."""
