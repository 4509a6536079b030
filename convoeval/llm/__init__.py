"""Operators for large text corpora: deduplication, scans, extraction, scoring and encoding."""
