"""The queries and SQL of this folder, by name."""

from __future__ import annotations

from . import conversation_repair, decontamination, document_fingerprints, hmm_scoring, html_extraction, jaccard_join, language_id, packing, quality_classifier, quality_rules, substring_dedup, token_counts, tokenizer_alignment

MODULES = (language_id, quality_rules, hmm_scoring, quality_classifier, substring_dedup, decontamination, html_extraction, packing, jaccard_join, token_counts, conversation_repair, tokenizer_alignment, document_fingerprints)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
