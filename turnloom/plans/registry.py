"""All registered queries with their SQL."""

from __future__ import annotations

from turnloom.plans import choosing, extraction, interchange, modelled, outputs, streams

MODULES = (extraction, choosing, modelled, interchange, outputs, streams)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
