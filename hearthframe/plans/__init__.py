"""Queries over the driver's tables: each applies operators and has a DuckDB twin where SQL can say it."""
