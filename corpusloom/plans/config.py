"""Retrieval settings: typed, with defaults for what is missing or can't be read."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

TRUE = ("1", "true", "yes", "y", "on")


@dataclass(frozen=True)
class RetrievalConfig:
    max_context_chars: int = 3700
    top_k: int = 2
    retrieval_pool_k: int = 72
    mmr_k: int = 28
    mmr_lambda: float = 0.68
    restrict_top_document: bool = True
    max_chunks_for_prompt: int = 0
    top_doc_chunk_neighbors_before: int = 0
    top_doc_chunk_neighbors_after: int = 0
    top_doc_section_expand: bool = True
    bm25_weight: float = 0.65
    rrf_linear_blend: float = 0.25
    hybrid_alpha_semantic: float = 0.30
    hybrid_rerank_enabled: bool = True
    retrieval_query_clean_enabled: bool = True
    retrieval_corpus_vocab_enabled: bool = True
    retrieval_generic_terms: tuple = ()
    retrieval_generic_terms_exclude: tuple = ()
    min_hybrid_rerank_score: float = 0.60
    initial_pool_multiplier: int = 2

    @classmethod
    def of(cls, raw: Mapping[str, object] | None) -> RetrievalConfig:
        values = {}
        for f in fields(cls):
            value = (raw or {}).get(f.name)
            if value is None:
                continue
            try:
                if isinstance(f.default, bool):
                    values[f.name] = value if isinstance(value, bool) else str(value).strip().lower() in TRUE
                elif isinstance(f.default, tuple):
                    values[f.name] = tuple(json.loads(value) if isinstance(value, str) else value)
                elif isinstance(f.default, int):
                    values[f.name] = int(float(value))
                else:
                    values[f.name] = float(value)
            except (TypeError, ValueError):
                continue
        return cls(**values)
