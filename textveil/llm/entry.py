"""The queries of this subpackage, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from . import ball_tree, bpe_lexicon, decontaminate, jaccard_join, lang_cnn, mixing_lm, quality_nbsvm, substring_dedup, token_counts, toxicity_pu

QUERIES = {
    "op10_lm_scoring": mixing_lm.op10_lm_scoring,
    "op3_token_counts": token_counts.op3_token_counts,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op5_language_id": lang_cnn.op5_language_id,
    "op4_toxicity": toxicity_pu.op4_toxicity,
    "op7_quality_classifier": quality_nbsvm.op7_quality_classifier,
    "op9_bpe_codec": bpe_lexicon.op9_bpe_codec,
    "op1_exact_top_k": ball_tree.op1_exact_top_k,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": ball_tree.OP1_SQL,
    "op6_ngram_jaccard_join": jaccard_join.OP6_SQL,
}
