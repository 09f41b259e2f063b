"""All queries of the lineage operators by name, with their SQL for DuckDB."""

from __future__ import annotations

from threadloom.plans import core_queries, extract_queries, fact_queries, graph_queries, metadata_queries, publish_queries, reconcile_queries, source_queries, text_queries, walk_queries

_PARTS = (graph_queries, reconcile_queries, fact_queries, text_queries, extract_queries, metadata_queries, source_queries, core_queries, walk_queries, publish_queries)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
