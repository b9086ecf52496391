"""Registry of the training-data queries. None has SQL: they are tested against brute force, round trips and held-out rows."""

from __future__ import annotations

from lexiloom.llm import format_copies, languages, leaks, lookalikes, mojibake, packing, pair_defects, personal, residue

QUERIES: dict = {}
for _module in (format_copies, residue, lookalikes, pair_defects, mojibake, languages, packing, leaks, personal):
    QUERIES |= _module.QUERIES
SQL: dict[str, str] = {}
