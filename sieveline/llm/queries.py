"""The registered queries of the corpus operators and of the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import (
    decontamination, hard_negatives, language_id, license_scan, lm_scoring, mixing, near_dedup, prefix_trie, quality_rules, secret_scan, suffix_dedup, token_output, warc_archive,
)

MODULES = (
    language_id, quality_rules, mixing, license_scan, near_dedup, decontamination, secret_scan, suffix_dedup, token_output, warc_archive, prefix_trie, lm_scoring, hard_negatives,
)
QUERIES = {"pipeline": corpus_pipeline.run}
ORACLE_SQL: dict[str, str] = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
