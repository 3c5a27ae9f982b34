"""All queries of the library and their SQL."""

from __future__ import annotations

from statera.plans import dataset_queries, evidence_queries, more_queries, reader_queries, recon_queries, review_queries, run_queries, scalar_queries, source_queries, store_queries

_PARTS = (recon_queries, scalar_queries, review_queries, source_queries, more_queries, evidence_queries, dataset_queries, reader_queries, store_queries, run_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
