"""Operators for preparing text corpora: filtering, deduplication, scanning, scoring, encoding."""
