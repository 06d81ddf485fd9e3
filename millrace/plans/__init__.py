"""Named queries over the given tables, with SQL counterparts."""

from millrace.plans import chunk_queries, conversation_queries, evaluation_queries, graph_queries, ingest_queries, retrieval_queries, text_queries  # noqa: F401
from millrace.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
