"""Operators for large text corpora: scoring, deduplication, extraction, search, tokenisation, packing."""
