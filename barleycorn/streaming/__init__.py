"""Structured Streaming forms of the read-level operators."""
