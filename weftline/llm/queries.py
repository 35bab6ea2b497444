"""The queries of this folder: one for each operator, over its whole table."""

from __future__ import annotations

from . import exact_dedup, filter_audit, importance_resampling, page_text, personal_data, quality_rules, sentence_spans, sentencepiece_codec, shingle_join, source_mixing, token_files, url_filter, vector_links

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_sentencepiece": sentencepiece_codec.query,
    "op3_page_text": page_text.query,
    "op4_source_mixing": source_mixing.query,
    "op5_shingle_join": shingle_join.query,
    "op6_token_files": token_files.query,
    "op7_vector_links": vector_links.query,
    "op8_sentence_spans": sentence_spans.query,
    "op9_quality_rules": quality_rules.query,
    "op10_personal_data": personal_data.query,
    "op11_exact_dedup": exact_dedup.query,
    "op12_importance_resampling": importance_resampling.query,
    "op13_filter_audit": filter_audit.query,
}
SQL = {
    "op1_url_filter": url_filter.SQL,
    "op4_source_mixing": source_mixing.SQL,
    "op11_exact_dedup": exact_dedup.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
