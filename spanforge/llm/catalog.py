"""The subpackage's queries and, where SQL can express one, its oracle."""

from __future__ import annotations

from . import bpe, centroids, divergence, html_text, line_dedup, near_dedup, passages, pii, quality_mil, quality_rules, source_mix, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_near_dedup": near_dedup.query,
    "op3_exact_topk": topk.query,
    "op4_passages": passages.query,
    "op5_html_text": html_text.query,
    "op6_source_mix": source_mix.query,
    "op7_toxicity": toxicity.query,
    "op8_quality_mil": quality_mil.query,
    "op9_bpe": bpe.query,
    "op10_quality_rules": quality_rules.query,
    "op11_centroids": centroids.query,
    "op12_personal_data": pii.query,
    "op13_divergence": divergence.query,
}

ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_near_dedup": near_dedup.SQL,
    "op3_exact_topk": topk.SQL,
    "op6_source_mix": source_mix.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_centroids": centroids.SQL,
    "op13_divergence": divergence.SQL,
}
