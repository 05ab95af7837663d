"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import answer_queries, metric_queries, model_queries, retrieval_queries, source_queries, text_queries

_PARTS = (answer_queries, metric_queries, model_queries, retrieval_queries, source_queries, text_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
