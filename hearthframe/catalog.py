"""All queries over the driver's tables, by name, with their DuckDB twins."""

from __future__ import annotations

from .plans import inventory, places, series, space, stock  # noqa: F401  each registers its queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
