"""Registry of the engine's queries and their DuckDB SQL."""

from __future__ import annotations

from tideglass.plans import cycle_queries, gate_queries, loop_queries, more_queries, panel_queries, reply_queries, source_queries

QUERIES = panel_queries.QUERIES | loop_queries.QUERIES | more_queries.QUERIES | gate_queries.QUERIES | reply_queries.QUERIES | source_queries.QUERIES | cycle_queries.QUERIES
ORACLE_SQL = panel_queries.ORACLE_SQL | loop_queries.ORACLE_SQL | more_queries.ORACLE_SQL | gate_queries.ORACLE_SQL | reply_queries.ORACLE_SQL | source_queries.ORACLE_SQL | cycle_queries.ORACLE_SQL
