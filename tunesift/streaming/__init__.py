"""Structured Streaming forms of the part-wise catalogue append."""
