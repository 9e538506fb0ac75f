"""All registered queries with their SQL."""

from streetlens.catalog import aggregates, filters, functions, relations, storage, streams  # noqa: F401
from streetlens.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
