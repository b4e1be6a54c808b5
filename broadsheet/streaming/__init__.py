"""Structured Streaming form of the ingest cycle."""
