"""Query registry and composed jobs."""

from __future__ import annotations

import importlib

_MODULES = ("queries_text", "queries_metadata", "queries_classify", "queries_quality", "queries_state")


def all_queries():
    """Registered queries and SQL twins, in declaration order."""
    for name in _MODULES:
        importlib.import_module(f"quire.plans.{name}")
    from quire.plans.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
