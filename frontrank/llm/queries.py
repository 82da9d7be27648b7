"""The operators of this subpackage as queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from frontrank.llm import decontamination, exact_dedup, hard_negatives, language_gru, license_scan, line_dedup, near_dedup, packing, piece_bpe, pii, quality_cnn, token_links, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op10_url_filter": url_filter.op10_url_filter,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_quality_classifier": quality_cnn.op3_quality_classifier,
    "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
    "op9_language_id": language_gru.op9_language_id,
    "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_token_links": token_links.op12_token_links,
    "op13_sentencepiece": piece_bpe.op13_sentencepiece,
}
ORACLE_SQL = {"op5_exact_dedup": exact_dedup.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op8_license_scan": license_scan.ORACLE_SQL}
