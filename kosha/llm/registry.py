"""Queries of the training-data operators with their DuckDB oracles."""

from __future__ import annotations

from . import (
    bpe_queries,
    conversation_queries,
    decontaminate_queries,
    exact_dedup_queries,
    jaccard_queries,
    language_queries,
    quality_model_queries,
    quality_queries,
    secret_queries,
    token_output_queries,
    url_queries,
    vector_code_queries,
    warc_queries,
)

QUERIES: dict = {}
ORACLES: dict = {}
_MODULES = (
    url_queries,
    secret_queries,
    decontaminate_queries,
    bpe_queries,
    quality_queries,
    warc_queries,
    quality_model_queries,
    language_queries,
    jaccard_queries,
    token_output_queries,
    conversation_queries,
    exact_dedup_queries,
    vector_code_queries,
)
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
