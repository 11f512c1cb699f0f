"""All registered queries with their SQL equivalents, by name."""

from __future__ import annotations

from tessera.plans import analytics, ingestion, retrieval

_ALL = {**retrieval.QUERIES, **analytics.QUERIES, **ingestion.QUERIES}
FLAGSHIP = "hybrid_adaptive"
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
