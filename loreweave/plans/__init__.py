"""Queries over the driver's tables and their SQL twins."""

from . import project_queries, store_queries, text_queries, upkeep_queries

QUERIES = {**text_queries.QUERIES, **store_queries.QUERIES, **upkeep_queries.QUERIES, **project_queries.QUERIES}
SQL = {**text_queries.SQL, **store_queries.SQL, **upkeep_queries.SQL, **project_queries.SQL}
