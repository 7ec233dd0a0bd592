"""Operators of a training-data pipeline: deduplication, extraction, formatting, search, filtering, packing."""
