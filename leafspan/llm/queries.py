"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from . import chat_tree, decontaminate, langid, license_scan, media, ngram_join, packing, paragraph_dedup, pii, scan_sql, suffix_dedup

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_language_id": langid.op3_language_id,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_paragraph_dedup": paragraph_dedup.op6_paragraph_dedup,
    "op7_retrieval_packing": packing.op7_retrieval_packing,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_media_columns": media.op9_media_columns,
    "op10_chat_tree": chat_tree.op10_chat_tree,
}
SQL = {
    "op3_language_id": scan_sql.language_id(),
    "op4_ngram_join": ngram_join.SQL,
    "op5_license_scan": scan_sql.license_scan(),
    "op8_suffix_dedup": scan_sql.SUFFIX_DEDUP,
    "op10_chat_tree": chat_tree.SQL,
}
