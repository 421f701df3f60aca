"""Queries of the training-data operators and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from quern.llm import bpe, chat, lm, mixing, neardup, quality, repair, resampling, sharding, toxicity, urls, vectors, vptrees

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_bpe": bpe.op2_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_sharding": sharding.op4_sharding,
    "op5_minhash_neardup": neardup.op5_minhash_neardup,
    "op6_url_filters": urls.op6_url_filters,
    "op7_chat_preferences": chat.op7_chat_preferences,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_vector_neardup": vectors.op9_vector_neardup,
    "op10_lm_scores": lm.op10_lm_scores,
    "op11_nearest_vectors": vptrees.op11_nearest_vectors,
    "op12_structure_repair": repair.op12_structure_repair,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.quality_sql(),
    "op3_mixing": mixing.MIX_SQL,
    "op4_sharding": sharding.SHARD_SQL,
    "op6_url_filters": urls.url_sql(),
    "op7_chat_preferences": chat.CHAT_SQL,
}
