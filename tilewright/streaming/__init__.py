"""Arriving run logs and label files, with Structured Streaming."""
