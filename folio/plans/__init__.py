"""Registered queries: name -> (plan, SQL for the same rows or None)."""

from __future__ import annotations

from folio.plans import browse, episodes, facets, ladder, logs, records, relations, scalars, shelves, statistics, stores, text

MODULES = (browse, relations, statistics, logs, text, shelves, records, scalars, episodes, facets, ladder, stores)


def _all() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def queries() -> dict:
    return {name: plan for name, (plan, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
