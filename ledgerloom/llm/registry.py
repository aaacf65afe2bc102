"""Queries of the corpus operators and their SQL, gathered from their modules."""

from __future__ import annotations

from . import bpe, hilbert_ann, lexical_search, line_dedup, minhash, packing, periodic_runs, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, toxicity

MODULES = (substring_dedup, quality_classifier, sharding, suffix_dedup, hilbert_ann, bpe, minhash, packing, line_dedup, quality_rules, toxicity, periodic_runs, lexical_search)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
