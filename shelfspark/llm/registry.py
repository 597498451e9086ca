"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from shelfspark.llm import bpe, chat_format, decontamination, html_extract, lm_scoring, merkle, ngram_join, periodic_runs, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filters

_MODULES = {
    "op1_html_extract": html_extract,
    "op2_bpe": bpe,
    "op3_quality_rules": quality_rules,
    "op4_suffix_dedup": suffix_dedup,
    "op5_quality_classifier": quality_classifier,
    "op6_chat_format": chat_format,
    "op7_ngram_join": ngram_join,
    "op8_token_counts": token_counts,
    "op9_url_filters": url_filters,
    "op10_decontamination": decontamination,
    "op11_merkle_manifest": merkle,
    "op12_periodic_runs": periodic_runs,
    "op13_lm_scoring": lm_scoring,
}


def queries() -> dict:
    return {**{name: module.query for name, module in _MODULES.items()}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
