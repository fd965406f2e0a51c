"""All registered queries of the library itself, and their SQL twins."""

from __future__ import annotations

from . import analysis_queries, reader_queries, search_queries, store_queries, stream_queries, structure_queries, text_queries

QUERIES, SQL = {}, {}
for _catalog in (text_queries.C, search_queries.C, analysis_queries.C, store_queries.C, structure_queries.C, reader_queries.C, stream_queries.C):
    QUERIES |= _catalog.queries
    SQL |= _catalog.sql
