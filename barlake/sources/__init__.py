"""Readers and writers: raw JSON, typed datasets, notes, incremental refresh."""
