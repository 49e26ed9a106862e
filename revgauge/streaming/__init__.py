"""Continuous ingest and volume with Structured Streaming."""
