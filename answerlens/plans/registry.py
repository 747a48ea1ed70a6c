"""Registered queries of the engine's own operators and their SQL counterparts."""

from __future__ import annotations

from answerlens.plans import q_composite, q_corpus, q_evaluation, q_files, q_retrieval, q_small, q_text, q_trace

MODULES = (q_text, q_retrieval, q_evaluation, q_corpus, q_trace, q_composite, q_small, q_files)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
