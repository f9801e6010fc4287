"""The queries of this folder, by name, with their DuckDB statements where SQL can state the result."""

from __future__ import annotations

from ledgerlens.llm import bpe, fill_middle, importance, language_id, license_scan, near_dup, packing, quality_cotrain, quality_rules, sharding, suffix_dedup, suffix_tree_lm, topk


def queries() -> dict:
    return {
        "op1_bayes_language_id": language_id.op1_bayes_language_id,
        "op2_byte_prefix_shards": sharding.op2_byte_prefix_shards,
        "op3_cotrained_quality": quality_cotrain.op3_cotrained_quality,
        "op4_swap_search_packing": packing.op4_swap_search_packing,
        "op5_diagonal_license_scan": license_scan.op5_diagonal_license_scan,
        "op6_mcd_quality_rules": quality_rules.op6_mcd_quality_rules,
        "op7_heap_bpe_roundtrip": bpe.op7_heap_bpe_roundtrip,
        "op8_weighted_minhash_classes": near_dup.op8_weighted_minhash_classes,
        "op9_previous_factor_dedup": suffix_dedup.op9_previous_factor_dedup,
        "op10_norm_bucket_topk": topk.op10_norm_bucket_topk,
        "op11_quickselect_resampling": importance.op11_quickselect_resampling,
        "op12_sparse_index_fim": fill_middle.op12_sparse_index_fim,
        "op13_suffix_tree_scores": suffix_tree_lm.op13_suffix_tree_scores,
    }


def oracle_sql() -> dict:
    return {"op5_diagonal_license_scan": license_scan.OP5_SQL, "op10_norm_bucket_topk": topk.OP10_SQL, "op11_quickselect_resampling": importance.OP11_SQL, "op12_sparse_index_fim": fill_middle.OP12_SQL}
