"""The queries of this package and their SQL."""

from __future__ import annotations

from corpusloom.llm import bpe, cross_tokens, exact_dedup, mixing, quality_classifier, quality_rules, secrets, simhash, spelling_variants, token_counts, tool_calls, toxicity, url_rules

QUERIES = {
    "op1_secrets": secrets.query,
    "op2_tool_calls": tool_calls.query,
    "op3_quality_rules": quality_rules.query,
    "op4_bpe": bpe.query,
    "op5_toxicity": toxicity.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_mixing": mixing.query,
    "op8_simhash": simhash.query,
    "op9_token_counts": token_counts.query,
    "op10_url_rules": url_rules.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_quality_classifier": quality_classifier.query,
    "op13_cross_tokens": cross_tokens.query,
}

ORACLES = {
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_token_counts": token_counts.ORACLE,
    "op11_spelling_variants": spelling_variants.ORACLE,
}
