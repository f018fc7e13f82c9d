"""Queries of the training-data operators and the SQL that the driver holds them against."""

from __future__ import annotations

from keyloom.llm import byte_bpe, decontamination, html_extraction, jaccard_join, language_id, language_model, quality_classifier, quality_rules, secrets, toxicity


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_language_model": language_model.op2_language_model,
        "op3_quality_classifier": quality_classifier.op3_quality_classifier,
        "op4_secret_scans": secrets.op4_secret_scans,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
        "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
        "op8_html_extraction": html_extraction.op8_html_extraction,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
        "base_language_model": language_model.base_language_model,
        "base_secret_scans": secrets.base_secret_scans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": quality_rules.SQL,
        "op6_benchmark_decontamination": decontamination.SQL,
        "op7_ngram_jaccard_join": jaccard_join.SQL,
        "base_language_model": language_model.BASE_SQL,
        "base_secret_scans": secrets.BASE_SQL,
    }
