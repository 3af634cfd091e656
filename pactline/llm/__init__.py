"""Operators for preparing training data: deduplication, filtering, tokenising and encoding."""
