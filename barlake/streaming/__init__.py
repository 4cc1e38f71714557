"""Structured Streaming jobs: ingest of newly landed files, and running bars."""
