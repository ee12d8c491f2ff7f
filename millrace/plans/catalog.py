"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import detection_queries, inspection_queries, more_queries, receivable_queries, text_queries, vector_queries

QUERIES: dict = {**receivable_queries.QUERIES, **inspection_queries.QUERIES, **text_queries.QUERIES, **more_queries.QUERIES, **detection_queries.QUERIES, **vector_queries.QUERIES}
SQL: dict[str, str] = {**receivable_queries.SQL, **inspection_queries.SQL, **text_queries.SQL, **more_queries.SQL, **detection_queries.SQL, **vector_queries.SQL}
