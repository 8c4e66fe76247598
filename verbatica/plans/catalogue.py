"""Every query of the library by name, with its SQL where SQL can say it."""

from __future__ import annotations

from . import capture_queries, distribution_queries, history_queries, information_queries, knowledge_queries, name_queries, notes_queries, path_queries, retrieval_queries, store_queries, taxonomy_queries, text_queries

QUERIES = {**taxonomy_queries.QUERIES, **knowledge_queries.QUERIES, **retrieval_queries.QUERIES, **information_queries.QUERIES, **text_queries.QUERIES, **history_queries.QUERIES, **notes_queries.QUERIES, **capture_queries.QUERIES, **distribution_queries.QUERIES, **store_queries.QUERIES, **name_queries.QUERIES, **path_queries.QUERIES}
