"""Operators for large text corpora: tokenising, cleaning, deduplication and quality scoring."""
