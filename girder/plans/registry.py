"""Queries over the driver's tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import audits, bills, catalogs, cells, edits, gates, lookups, ordering, repairs  # noqa: F401  each registers its queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
