"""Every query of the retrieval engine by name, and the SQL that states its result."""

from __future__ import annotations

from siltstone.plans import analysis_queries, chunk_queries, document_queries, file_queries, index_queries, metadata_queries, search_queries, source_queries, store_queries

MODULES = (chunk_queries, search_queries, metadata_queries, analysis_queries, source_queries, index_queries, store_queries, file_queries, document_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE.items()}
