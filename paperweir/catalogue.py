"""Every registered query of the library's own operators, and the SQL that checks it."""

from __future__ import annotations

from paperweir.plans import chunk_queries, identifier_queries, report_queries, signal_queries

_MODULES = (identifier_queries, signal_queries, chunk_queries, report_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
