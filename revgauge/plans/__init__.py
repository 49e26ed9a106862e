"""Whole stages and the query surface, composed from operators."""
