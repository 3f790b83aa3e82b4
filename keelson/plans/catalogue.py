"""All queries and their DuckDB SQL."""

from __future__ import annotations

from . import file_queries, map_queries, oracles, queries

QUERIES = queries.QUERIES | file_queries.QUERIES | map_queries.QUERIES
ORACLES = oracles.ORACLES | file_queries.ORACLES | map_queries.ORACLES
