"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

from graphloom.llm import sql

#: query name -> module of this package that defines it
NAMES = {
    "op10_lm_scoring": "brown",
    "op11_media_columns": "media",
    "op12_prefix_trie": "prefix_trie",
    "op13_filter_audit": "filter_audit",
    "op1_toxicity": "toxicity",
    "op2_exact_topk": "topk",
    "op3_quality_classifier": "quality",
    "op4_html_extraction": "dom",
    "op5_simhash_near_dedup": "simhash",
    "op6_sharding": "sharding",
    "op7_sentencepiece": "pieces",
    "op8_language_id": "language",
    "op9_benchmark_decontamination": "decontaminate",
}


def _query(name: str):
    """A query whose module is imported when it runs: one that cannot be imported leaves the others alone."""

    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"graphloom.llm.{NAMES[name]}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator over whole tables."""
    return {
        "op2_exact_topk": sql.EXACT_TOPK, "op9_benchmark_decontamination": sql.DECONTAMINATION, "op12_prefix_trie": sql.PREFIX_TRIE, "op13_filter_audit": sql.FILTER_AUDIT,
    }
