"""Queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from . import conversations, decontaminate, jaccard, langid, lexical, negatives, packing, pieces, quality, sharding, suffixes, topk, training_order


def queries() -> dict:
    return {
        "op6_training_order": training_order.op6_training_order,
        "op5_suffix_dedup": suffixes.op5_suffix_dedup,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op1_greedy_string_tiling": decontaminate.op1_greedy_string_tiling,
        "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
        "op2_language_id": langid.op2_language_id,
        "op7_compression_quality": quality.op7_compression_quality,
        "op3_exact_top_k": topk.op3_exact_top_k,
        "op4_chat_formatting": conversations.op4_chat_formatting,
        "op9_extendible_sharding": sharding.op9_extendible_sharding,
        "op11_best_fit_packing": packing.op11_best_fit_packing,
        "op12_presence_masks": lexical.op12_presence_masks,
        "op13_hyperplane_negatives": negatives.op13_hyperplane_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_ngram_jaccard": jaccard.SQL, "op3_exact_top_k": topk.SQL, "op4_chat_formatting": conversations.SQL, "op9_extendible_sharding": sharding.SQL, "op12_presence_masks": lexical.SQL, "op13_hyperplane_negatives": negatives.SQL}
