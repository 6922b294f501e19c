"""All reference-parity queries and their DuckDB statements, by operator id."""

from __future__ import annotations

from tesserae.plans import analytics, ingest, retrieval, rules, texts

MODULES = (retrieval, analytics, texts, ingest, rules)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
