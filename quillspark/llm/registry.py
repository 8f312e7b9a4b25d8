"""The queries of this subpackage."""

from __future__ import annotations

from . import jaccard_join, language, licenses, oracles, packing, personal, piece_transducer, quantised_search, suffix_tree, token_counts, tree_forest


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_language_id": language.op3_language_id,
        "op4_lm_scores": suffix_tree.op4_lm_scores,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_sentencepiece": piece_transducer.op7_sentencepiece,
        "op8_personal_data": personal.op8_personal_data,
        "op9_near_vectors": tree_forest.op9_near_vectors,
        "op10_quantised_search": quantised_search.op10_quantised_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": oracles.license_scan(), "op6_jaccard_join": oracles.jaccard_join(), "op9_near_vectors": oracles.near_vectors(), "op10_quantised_search": oracles.nearest_vectors()}
