"""All queries and their DuckDB equivalents."""

from __future__ import annotations

from codelode.plans import engine_queries  # noqa: F401  adds its own
from codelode.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
