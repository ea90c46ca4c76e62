"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, filter_audit, fm_index, hamerly, html, language, mixing, ngram_join, quality, secrets, suffix_dedup, tokenfiles, topk

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_mixing": mixing.op5_mixing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_secrets": secrets.op7_secrets,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_language_id": language.op9_language_id,
    "op10_html_text": html.op10_html_text,
    "op11_centroid_clusters": hamerly.op11_centroid_clusters,
    "op12_decontamination": fm_index.op12_decontamination,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op2_quality_rules": quality.OP2_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op8_exact_topk": topk.OP8_SQL,
    "op11_centroid_clusters": hamerly.OP11_SQL,
    "op12_decontamination": fm_index.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
