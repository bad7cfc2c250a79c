"""All queries by name, with their SQL."""

from __future__ import annotations

from quire.plans import figure_queries, store_queries, text_queries
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "figure_queries", "store_queries", "text_queries"]
