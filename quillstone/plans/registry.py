"""All core queries and their SQL by name."""

from __future__ import annotations

from . import corpus, records, retrieval, rewrites

_MODULES = [records, retrieval, corpus, rewrites]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
FLAGSHIP = QUERIES["hybrid_search"]
