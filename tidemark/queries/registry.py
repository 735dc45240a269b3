"""All queries of the engine."""

from __future__ import annotations

from tidemark.queries import sql_queries, store_queries

QUERIES = {**sql_queries.QUERIES, **store_queries.QUERIES}
ORACLE_SQL = {**sql_queries.ORACLE_SQL, **store_queries.ORACLE_SQL}
