"""Queries and SQL of the numbered operators."""

from hailbook.llm import (
    byte_bpe,
    decontamination,
    exact_dedup,
    hard_negatives,
    language_id,
    licence_scan,
    line_dedup,
    ngram_join,
    quality,
    spelling_variants,
    substring_dedup,
    suffix_dedup,
    token_counts,
)

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_ngram_join": ngram_join.query,
    "op5_token_counts": token_counts.query,
    "op6_language_id": language_id.query,
    "op7_quality": quality.query,
    "op8_licence_scan": licence_scan.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_spelling_variants": spelling_variants.query,
    "op13_line_dedup": line_dedup.query,
}
ORACLES = {
    "op3_substring_dedup": substring_dedup.SQL,
    "op4_ngram_join": ngram_join.SQL,
    "op5_token_counts": token_counts.SQL,
    "op8_licence_scan": licence_scan.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_line_dedup": line_dedup.SQL,
}
