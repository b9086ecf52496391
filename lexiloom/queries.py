"""Registry of the core queries and their SQL equivalents."""

from __future__ import annotations

from lexiloom.plans import records, texts  # noqa: F401 - texts registers its queries with records

QUERIES = dict(records.QUERIES)
SQL = dict(records.SQL)
