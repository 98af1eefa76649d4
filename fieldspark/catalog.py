"""Registered queries of the core operators and their DuckDB counterparts."""

from __future__ import annotations

from fieldspark.queries import merges, passes, runs, schemas, segments, structures

MODULES = (segments, merges, schemas, structures, runs, passes)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
