"""Operators of a training-data pipeline: scoring, decontamination, packing, deduplication, quality, extraction."""
