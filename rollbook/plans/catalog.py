"""Imports every module that registers queries, and exposes the registry."""

from __future__ import annotations

from rollbook.plans import changes, entities, io, listing, live, lookup, reports, searching, statistics, textual  # noqa: F401
from rollbook.plans.registry import OPERATORS, ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL", "OPERATORS"]
