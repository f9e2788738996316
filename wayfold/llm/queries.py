"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from wayfold.llm import language, licences, packing, pieces, quality, rules, sharding, simhash, topk, urls

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_simhash": simhash.query,
    "op3_quality_classifier": quality.query,
    "op4_url_filters": urls.query,
    "op5_exact_top_k": topk.query,
    "op6_quality_rules": rules.query,
    "op7_licence_scan": licences.query,
    "op8_language_id": language.query,
    "op9_hilbert_sharding": sharding.query,
    "op10_sentencepiece": pieces.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": urls.oracle(),
    "op5_exact_top_k": topk.oracle(),
    "op6_quality_rules": rules.oracle(),
    "op7_licence_scan": licences.oracle(),
}
