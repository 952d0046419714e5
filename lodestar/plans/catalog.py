"""All registered queries and their SQL."""

from __future__ import annotations

from . import acquire_queries, data_queries, graph_queries, screening_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in (screening_queries, graph_queries, data_queries, acquire_queries):
    QUERIES |= _m.query.queries
    ORACLE_SQL |= _m.query.sql
