"""All queries of the library but those of the llm subpackage, and their SQL."""

from __future__ import annotations

from quillstack.plans import corpus_queries, eval_queries, ingest_queries, step_queries

_PARTS = (ingest_queries.catalogue, step_queries.catalogue, eval_queries.catalogue)
QUERIES, SQL = dict(corpus_queries.QUERIES), dict(corpus_queries.SQL)
for _part in _PARTS:
    QUERIES |= _part.queries
    SQL |= _part.sql
