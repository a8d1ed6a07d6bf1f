"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from filigree.plans import data_quality, graph_queries, search_queries
from filigree.plans.graph_queries import flagship

_MODULES = [data_quality, graph_queries, search_queries]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

__all__ = ["ORACLE", "QUERIES", "flagship"]
