"""Structured Streaming forms of ingest, volume, rollups and thread state."""
