"""All queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from . import queries_learned, queries_match, queries_order, queries_text

MODULES = (queries_learned, queries_match, queries_order, queries_text)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
