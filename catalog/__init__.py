"""Registered queries over the driver's tables, each beside its SQL oracle."""

from catalog.base import ORACLE, QUERIES
from catalog import corpus, groups, intake, ranking, similar, sketched, stores, streams, text, vectors  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
