"""Operators on training corpora: dedup, quality, mixing, packing, scans, formatting and extraction."""
