"""All queries of the library by name, with the same result in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from meritgraph.plans import graph_queries, score_queries, source_queries

QUERIES = graph_queries.QUERIES | score_queries.QUERIES | source_queries.QUERIES
SQL = graph_queries.SQL | score_queries.SQL | source_queries.SQL
FLAGSHIP = graph_queries.rank_top_participants
