"""Registered queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from entry_queries import extraction, lines, registry, reporting, routing, streams
from entry_queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "extraction", "lines", "registry", "reporting", "routing", "streams"]
