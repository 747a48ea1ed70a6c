"""Queries over the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from answerlens.llm.ann import op1_kmeans_tree
from answerlens.llm.bpe_automaton import op5_bpe_automaton
from answerlens.llm.caps import OP11_SQL, op11_spherical_caps
from answerlens.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from answerlens.llm.katz import op2_katz
from answerlens.llm.language_id import op9_language_id
from answerlens.llm.merkle import OP13_SQL, op13_merkle
from answerlens.llm.mixing import op10_mix_sources
from answerlens.llm.ngram_join import op6_ngram_join
from answerlens.llm.phrases import OP12_SQL, op12_phrases
from answerlens.llm.quality import op3_quality
from answerlens.llm.repeated_text import op4_repeated_text
from answerlens.llm.token_files import op8_token_files

QUERIES = {
    "op1_kmeans_tree": op1_kmeans_tree,
    "op2_katz": op2_katz,
    "op3_quality": op3_quality,
    "op4_repeated_text": op4_repeated_text,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_ngram_join": op6_ngram_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_files": op8_token_files,
    "op9_language_id": op9_language_id,
    "op10_mix_sources": op10_mix_sources,
    "op11_spherical_caps": op11_spherical_caps,
    "op12_phrases": op12_phrases,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {
    "op7_exact_dedup": OP7_SQL,
    "op11_spherical_caps": OP11_SQL,
    "op12_phrases": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
