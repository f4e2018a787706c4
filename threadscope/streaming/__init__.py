"""Structured Streaming versions of ingestion, live counts and duplicate removal."""
