"""Registry of the core queries and of their SQL counterparts."""

from __future__ import annotations

from garimpo.queries import data, pipeline, search, state, structure, tabular, texts

MODULES = [tabular.R, texts.R, search.R, state.R, structure.R, pipeline.R]


def core_queries() -> dict:
    found = dict(data.QUERIES)
    for r in MODULES:
        found |= r.queries
    return found


def core_sql() -> dict:
    found = dict(data.SQL)
    for r in MODULES:
        found |= r.sql
    return found
