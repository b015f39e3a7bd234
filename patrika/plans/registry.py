"""All queries of the core."""

from __future__ import annotations

from patrika.plans import dates, extraction, feeds, files, parsing, records

MODULES = [dates, records, extraction, parsing, feeds, files]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
