"""All queries of the core and their SQL."""

from __future__ import annotations

from weftline.plans import data_queries, handling_queries, reference_queries

_MODULES = (data_queries, reference_queries, handling_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
