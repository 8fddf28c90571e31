"""All queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, contamination, divergence, html, language, packing, q_dedup, quality, secrets, spelling, token_counts

QUERIES = {
    "op1_substring_dedup": q_dedup.op1_substring_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_packing": packing.op6_packing,
    "op7_decontamination": contamination.op7_decontamination,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_simhash_near_dedup": q_dedup.op9_simhash_near_dedup,
    "op10_exact_dedup": q_dedup.op10_exact_dedup,
    "op11_language_id": language.op11_language_id,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
SQL = {
    "op1_substring_dedup": q_dedup.OP1_SQL,
    "op3_chat_formatting": chat.SQL,
    "op7_decontamination": contamination.SQL,
    "op10_exact_dedup": q_dedup.OP10_SQL,
    "op12_source_divergence": divergence.SQL,
}
