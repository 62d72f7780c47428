"""Operators for large text corpora: deduplication, filtering, mixing, tokens and search."""
